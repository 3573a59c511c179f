"""Examples and batches for training a model that finds a subject's spans and then its objects' spans, and what follows
the training: which epoch was best, and averaged weights. The model itself is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thresher.functions import text as tx

from .evaluate import scores
from .index import dense_ids
from .lineage import scratch

SPAN = "struct<start:int,end:int>"
OBJECT = "struct<start:int,end:int,predicate:int>"


def found_triples(rows: DataFrame, predicates: list[str]) -> DataFrame:
    """rows (tokens; spo_list of subject, predicate, object, the first and last as tokens) with found: struct(subject,
    object) of the triples whose subject and object stand in the tokens, each at its first place; sorted, each once. An
    object has the place of its predicate in the list. Triples of other predicates, of empty or null spans, and those that do
    not stand there teach nothing and give nothing."""
    number = F.create_map(*(F.lit(x) for n, p in enumerate(predicates) for x in (p, n))) if predicates else F.lit(None).cast("map<string,int>")

    # Places are found in a step of their own, so that each is searched for once.
    at = lambda t, side: F.when(F.size(t[side]) > 0, tx.find_sequence(t[side], F.col("tokens")))
    places = F.transform("spo_list", lambda t: F.struct(at(t, "subject").alias("s"), F.size(t["subject"]).alias("m"), at(t, "object").alias("o"), F.size(t["object"]).alias("n"), F.try_element_at(number, t["predicate"]).alias("p")))
    stand = F.filter(places, lambda x: (x["s"] >= 0) & (x["o"] >= 0) & x["p"].isNotNull())
    found = F.transform(stand, lambda x: F.struct(F.struct(x["s"].alias("start"), (x["s"] + x["m"] - 1).alias("end")).alias("subject"), F.struct(x["o"].alias("start"), (x["o"] + x["n"] - 1).alias("end"), x["p"].alias("predicate")).alias("object")))
    return rows.withColumn("found", F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast(f"array<struct<subject:{SPAN},object:{OBJECT}>>")))))


def drawn(name: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that depends on a name alone, so that a task that runs again draws the same."""
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 7), 16, 10).cast("long") % n).cast("int")


def span_examples(rows: DataFrame, predicates: list[str], seed: int = 0, id_col: str = "id") -> DataFrame:
    """id, tokens, subjects, subject, objects: an example of each row in which a triple is found. subjects: the spans
    of all subjects, ascending. subject: a start and an end drawn each for itself, the end from those of subjects at or
    after the start, so that it may be no subject. objects: those of that span. A draw depends on seed and id alone; an
    epoch takes a seed of its own. No shuffle."""
    f = found_triples(rows.select(F.col(id_col).alias("id"), "tokens", "spo_list"), predicates)
    # Outer, and the filter on what comes out, as else all places would be searched for a second time for it.
    f = f.select("id", "tokens", F.explode_outer(F.filter(F.array("found"), lambda x: F.size(x) > 0)).alias("found")).where("found IS NOT NULL")
    f = f.withColumn("subjects", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["subject"]))))
    name = lambda what: F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(what))
    f = f.withColumn("s", F.get(F.transform("subjects", lambda x: x["start"]), drawn(name("start"), F.size("subjects"))))
    ends = F.filter(F.transform("subjects", lambda x: x["end"]), lambda e: e >= F.col("s"))
    f = f.withColumn("ends", ends).withColumn("subject", F.struct("s", F.get("ends", drawn(name("end"), F.size("ends"))).alias("e")).cast(SPAN))
    objects = F.transform(F.filter("found", lambda x: x["subject"] == F.col("subject")), lambda x: x["object"])
    return f.select("id", "tokens", "subjects", "subject", objects.alias("objects"))


def subject_labels(subjects: Column, length: Column) -> Column:
    """position x (start, end): 1 where a subject starts or ends, 0 elsewhere."""
    flag = lambda i, side: F.exists(subjects, lambda x: x[side] == i).cast("int")
    return _positions(length, lambda i: F.array(flag(i, "start"), flag(i, "end")), "array<array<int>>")


def object_labels(objects: Column, length: Column, n_predicates: int) -> Column:
    """position x predicate x (start, end). Dense, as models take it: objects themselves are far smaller."""
    flag = lambda i, p, side: F.exists(objects, lambda x: (x[side] == i) & (x["predicate"] == p)).cast("int")
    return _positions(length, lambda i: F.transform(F.sequence(F.lit(0), F.lit(n_predicates - 1)), lambda p: F.array(flag(i, p, "start"), flag(i, p, "end"))), "array<array<array<int>>>")


def _positions(length: Column, of, kind: str) -> Column:
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), of)).otherwise(F.array().cast(kind))


def batches(examples: DataFrame, size: int, order: list[str | Column], pad: Column | str = "") -> DataFrame:
    """batch, rows: the examples in order, ``size`` to a batch (the last may hold fewer). rows: structs of id, tokens, subjects,
    subject, objects and n_tokens, in order, whose tokens are padded to the longest of the batch. A group never holds more
    than ``size`` examples. Labels past a text's own tokens are all 0, as subject_labels gives them for the padded length.
    Order must tell all rows apart; a shuffled epoch orders by a hash of id and seed."""
    fill = pad if isinstance(pad, Column) else F.lit(pad)
    # Written first, as ranges are sampled and the examples would be made once for that and once more for their batches.
    path = scratch(examples.sparkSession)
    examples.write.parquet(path)
    rows = examples.sparkSession.read.schema(examples.schema).parquet(path).withColumn("example", F.struct("id", "tokens", "subjects", "subject", "objects", F.size("tokens").alias("n_tokens")))
    at = dense_ids(rows, "example", order)
    groups = at.groupBy(F.floor(F.col("id") / size).cast("long").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("id", "example"))).alias("r"), F.max(F.size("example.tokens")).alias("width"))
    padded = F.transform("r", lambda x: x["example"].withField("tokens", F.concat(x["example"]["tokens"], F.array_repeat(fill, F.col("width") - F.size(x["example"]["tokens"])))))
    return groups.select("batch", padded.alias("rows"))


def epochs(rows: DataFrame, epoch: str = "epoch", truth: str = "spo_list", predicted: str = "spo_list_pred") -> DataFrame:
    """epoch, f1, precision, recall, best (the greatest f1 so far), kept (whether the epoch's weights replace those kept, which
    equal scores do too). rows: predictions of each epoch. Only a row for each epoch meets in one place."""
    of_epochs = scores(rows, truth, predicted, by=[epoch])
    w = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return of_epochs.withColumn("best", F.max("f1").over(w)).withColumn("kept", F.col("f1") == F.col("best"))


def averaged_weights(steps: DataFrame, decay: float = 0.999) -> DataFrame:
    """name, weights: the exponential moving average of each array of weights, which starts as that of step 0: at every
    later step average = decay * average + (1 - decay) * weights. steps (name, step, weights): each step from 0 to the
    last once. Written as a weighted sum, so steps are added up where they are and need no order."""
    last = steps.groupBy("name").agg(F.max("step").alias("last"))
    share = F.pow(F.lit(decay), F.col("last") - F.col("step")) * F.when(F.col("step") == 0, 1.0).otherwise(1 - decay)
    cells = steps.join(last, "name").select("name", share.alias("share"), F.posexplode("weights").alias("i", "x"))
    sums = cells.groupBy("name", "i").agg(F.sum(F.col("share") * F.col("x").cast("double")).alias("x"))
    return sums.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("name", F.col("c.x").alias("weights"))
