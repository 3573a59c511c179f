"""Extraction quality: compared sets of triples, micro precision, recall and F1, and the decoding of span scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thresher.functions import text as tx

#: What each sum starts from, so that nothing is divided by zero. Fixed value.
SEED = 1e-10
SPO = "array<struct<subject:string,predicate:string,object:string>>"
#: Scores over which a start or an end counts. Fixed values.
START, END = 0.6, 0.5


def comparable(spo: Column) -> Column:
    """Triples as a set of strings, subject and object word by word, then the predicate unless it is null, parted by line
    breaks, which words don't hold. Spark compares strings by hashing, structs each with each."""
    norm = lambda x: F.coalesce(F.btrim(F.regexp_replace(F.lower(x), r"\s+", " ")), F.lit(""))
    return F.array_distinct(F.transform(spo, lambda t: F.concat_ws("\n", norm(t["subject"]), norm(t["object"]), t["predicate"])))


def _compared(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = comparable(F.coalesce(F.col(truth), F.array().cast(SPO))), comparable(F.coalesce(F.col(predicted), F.array().cast(SPO)))
    return rows.withColumns({"__t": t, "__p": p}).withColumns({"right": F.array_intersect("__p", "__t"), "new": F.array_except("__p", "__t"), "lack": F.array_except("__t", "__p")}).drop("__t", "__p")


def compare(rows: DataFrame, truth: str = "spo_list", predicted: str = "spo_list_pred") -> DataFrame:
    """rows with right (in both), new (only predicted) and lack (only true)."""

    def triples(x: str) -> Column:
        # Each string is taken apart once: a lambda's expressions are worked out as often as they are named.
        part = lambda p, i: F.get(p, F.lit(i))
        return F.transform(F.transform(x, lambda t: F.split(t, "\n", 3)), lambda p: F.struct(part(p, 0).alias("s"), part(p, 2).alias("p"), part(p, 1).alias("o")))

    return _compared(rows, truth, predicted).withColumns({c: triples(c) for c in ("right", "new", "lack")})


def counts(rows: DataFrame, truth: str = "spo_list", predicted: str = "spo_list_pred") -> DataFrame:
    """rows with n_right, n_new, n_lack: how many triples compare finds, without taking them apart."""
    c = _compared(rows, truth, predicted)
    return c.withColumns({f"n_{x}": F.size(x).cast("long") for x in ("right", "new", "lack")}).drop("right", "new", "lack")


def scores(rows: DataFrame, truth: str = "spo_list", predicted: str = "spo_list_pred", by: list[str] | None = None) -> DataFrame:
    """One row: f1, precision, recall, over all triples of all rows; with by, one row for each value of its columns."""
    c = _compared(rows, truth, predicted)
    x = F.lit(SEED) + F.coalesce(F.sum(F.size("right")), F.lit(0))
    y = F.lit(SEED) + F.coalesce(F.sum(F.size("right") + F.size("new")), F.lit(0))
    z = F.lit(SEED) + F.coalesce(F.sum(F.size("right") + F.size("lack")), F.lit(0))
    return c.groupBy(*by or []).agg((2 * x / (y + z)).alias("f1"), (x / y).alias("precision"), (x / z).alias("recall"))


def decode_spans(starts: Column, ends: Column, start_over: float = START, end_over: float = END) -> Column:
    """(start, end) for each start score over its threshold and the first end at or after it over its own."""
    s = F.filter(F.transform(starts, lambda x, i: F.when(x > start_over, i)), lambda i: i.isNotNull())
    e = F.filter(F.transform(ends, lambda x, i: F.when(x > end_over, i)), lambda i: i.isNotNull())
    pairs = F.transform(s, lambda a: F.struct(a.alias("start"), F.get(F.filter(e, lambda b: b >= a), F.lit(0)).alias("end")))
    return F.filter(pairs, lambda p: p["end"].isNotNull())


def decode_objects(starts: Column, ends: Column, start_over: float = START, end_over: float = END) -> Column:
    """(start, end, predicate) of score matrices position x predicate: a start and the first end at or after it of the
    same predicate."""

    def places(m: Column, over: float) -> Column:
        return F.flatten(F.transform(m, lambda row, i: F.filter(F.transform(row, lambda x, p: F.when(x > over, F.struct(i.alias("at"), p.alias("predicate")))), lambda x: x.isNotNull())))

    e = places(ends, end_over)
    pairs = F.transform(places(starts, start_over), lambda a: F.struct(a["at"].alias("start"), F.get(F.filter(e, lambda b: (b["at"] >= a["at"]) & (b["predicate"] == a["predicate"])), F.lit(0))["at"].alias("end"), a["predicate"].alias("predicate")))
    return F.filter(pairs, lambda p: p["end"].isNotNull())
