"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are densities per word: hits of a fixed lexicon, plain and after undoing obfuscation, hits near a
second person, hits of fragments that the labelled rows themselves single out (so that languages and spellings which the
lexicon doesn't know count too), and the rates of capitals, punctuation and obfuscated words. Labels are learned from a
sample of at most ``max_rows`` labelled rows, chosen by a hash; fragments are counted on the executors, and only the
sample's dense features reach the driver. Trees are fitted on histograms. Their scores out of fold, where neither the trees
nor the choice of fragments has seen the rows of the fold or texts equal to them, are calibrated with the
pool-adjacent-violators algorithm. A score is read from the line through the middles of the calibrated steps; beyond the
first and the last all scores are those of the step and tie. Scoring passes once over the words of every whole text and
once over its characters for all fragments, in pieces of a batch, with a model of fixed size.

Cases: a null or empty text has features of zero and gets the score that the model gives them. Rows with a null label or
a label other than 0 and 1 are not learned from; a row with several labels counts each. Without labels of both kinds the
score is the share of the label that there is, or 0. Repeated rows get repeated scores, equal texts equal ones. An empty
table gives an empty result. The score takes the place of a kept column of its name; other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_row, checkpoint, map_texts, quoted, read, texts

#: Labelled rows that are learned from at most.
MAX_ROWS = 20_000
#: Of these, rows whose fragments are counted at most.
GRAM_ROWS = 4_000
#: Fragments that become features of their own.
GRAMS = 48
SIZES = (5, 6, 7)
FOLDS = 5
#: Sums that a worker holds before it hands them on.
HELD = 200_000
#: Common insults of four languages, written down without looking at labelled rows.
LEXICON = {
    "en": frozenset((
        "arse arsehole ass asshole assholes bastard bastards bitch bitches blockhead bonehead bozo brainless bullshit buffoon clown clowns coward cowards crap creep creeps cretin crybaby damn "
        "degenerate degenerates dickhead dimwit dirtbag disgrace disgusting dope dork douche douchebag dumb dumbass dumbest dunce faggot failure fatso filth filthy fool fools freak freaks fuck fucked "
        "fucker fucking garbage goon halfwit hate hypocrite idiot idiotic idiots ignorant imbecile imbeciles incompetent inferior jackass jerk jerks kill lame liar liars loser losers lowlife lunatic "
        "maggot maniac moron moronic morons motherfucker nasty nincompoop numbskull nutjob oaf parasite parasites pathetic pervert pig pigs piss prick psycho rat rats repulsive retard retarded "
        "rubbish savage savages scum scumbag shit shithead shitty sicko simpleton slob slut stupid stupidity snake sucks swine thug thugs trash trashy traitor twat twit ugly useless vermin vile wanker weakling weirdo "
        "whore wimp worthless wretch"
    ).split()),
    "de": frozenset((
        "abschaum affe arsch arschloch bastarde blödmann blöde blöd depp deppen drecksack dreckig dumm dumme dummkopf dämlich ekelhaft fresse hackfresse hirnlos hurensohn hässlich idioten idiotin "
        "lügner lächerlich missgeburt mistkerl miststück müll nichtsnutz penner pfui sau saudumm scheisse scheiße scheiß schlampe schwachkopf schwachsinnig schwein schweine spinner trottel versager "
        "vollidiot wertlos wichser widerlich"
    ).split()),
    "fr": frozenset((
        "abruti abrutie abrutis bouffon bouffonne clébard conard connard connards connasse conne crétin crétine crétins dégage dégueulasse débile débiles enculé enfoiré foutre idiote imbécile "
        "imbéciles lâche mensonge menteur merde merdeux minable minables misérable moche nul nulle nuls ordure ordures pathétique pourri pourriture pute racaille raté ratés salaud salauds salope "
        "saloperie stupide taré tarés gueule vermine"
    ).split()),
    "es": frozenset((
        "asco asqueroso asquerosa basura bobo boba burro cabrón cabrones callate cerdo cerdos cobarde cretino cretinos estúpida estúpidas estúpido estúpidos fracasado fracasados feo gilipollas "
        "hijoputa idiotas imbécil imbéciles inútil inútiles inepto ladrón maldita maldito marica mentiroso mierda miserable patético pendejo pendejos perdedor perra puta puto rata ratas repugnante "
        "ridículo sucio tarado tonta tonto tontos zorra"
    ).split()),
}
INSULTS = frozenset().union(*LEXICON.values())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi vous ton tes ta votre vos usted ustedes tú ti tus vosotros eres".split())
_WORD = re.compile(r"[\w@$*|+]+(?:!+[\w@$*|+]+)*")
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
#: Words between an insult and a second person at most.
NEAR = 8
FIXED = (*(f"insults_{x}" for x in LEXICON), "insults", "undone", "near_you", "shouted", "mixed", "spaced", "capitals", "punctuation", "exclamation", "odd_marks", "digits", "word_length", "distinct", "log_words")


@lru_cache(20_000)
def undone(word: str) -> bool:
    """Is the word, which isn't all letters, an insult whose letters were replaced (by digits and signs, or by stars)?"""
    plain = word.translate(_LEET)
    if plain in INSULTS or plain.replace("_", "") in INSULTS:
        return True
    if "*" not in plain or sum(map(str.isalpha, plain)) < 2:
        return False
    hidden = re.compile(re.escape(plain).replace("\\*", "."))
    return any(hidden.fullmatch(x) for x in INSULTS)


def spaced_out(words: list[str]) -> int:
    """Runs of four single letters or more."""
    runs = now = 0
    for w in words:
        now = now + 1 if len(w) == 1 and w.isalpha() else 0
        runs += now == 4
    return runs


def fixed_features(text: str, low: str) -> list[float]:
    words = _WORD.findall(low)
    n, kinds = max(1, len(words)), Counter(words)
    met = kinds.keys() & INSULTS
    hits = sum(kinds[w] for w in met)
    odd_words = [w for w in kinds if not w.isalpha()]
    mixed = sum(kinds[w] for w in odd_words if w[0].isalpha() and w[-1].isalpha() and not w.replace("_", "").isalpha())
    more = sum(kinds[w] for w in odd_words if not w.isdigit() and undone(w))
    near = shouted = 0
    if hits:
        at = [k for k, w in enumerate(words) if w in INSULTS]
        you = np.array([k for k, w in enumerate(words) if w in SECOND] or [-1 << 40])
        where = np.searchsorted(you, at)
        near = sum(min(abs(you[min(i, len(you) - 1)] - k), abs(k - you[max(i - 1, 0)])) <= NEAR for i, k in zip(where, at, strict=True))
        own = _WORD.findall(text)
        shouted = sum(own[k].isupper() for k in at) if len(own) == len(words) else 0
    spaced = spaced_out(words) if sum(c for w, c in kinds.items() if len(w) == 1) > 3 else 0
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[0xC0:].sum()))
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    odd = int(count[[35, 36, 37, 38, 42, 64, 94, 124, 126]].sum())
    return [
        *(sum(kinds[w] for w in met & some) / n for some in LEXICON.values()), hits / n, (hits + more) / n, near / n, shouted / n, mixed / n, spaced / n, int(count[65:91].sum()) / letters, marks / n, int(count[33]) / n, odd / n,
        int(count[48:58].sum()) / n, letters / n, len(kinds) / n, float(np.log1p(len(words))),
    ]


@lru_cache(16)
def _finder(grams: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, g in enumerate(grams):
        found.add_word(g, k)
    found.make_automaton()
    return found


def gram_counts(low: str, grams: tuple[str, ...]) -> list[int]:
    """How often each fragment is in the text, places that overlap included."""
    out = [0] * len(grams)
    if grams:
        for _, k in _finder(grams).iter(low):
            out[k] += 1
    return out


def features(text: str, grams: tuple[str, ...]) -> list[float]:
    """The fixed features and the density of each fragment; Model.columns takes from these what a model looks at."""
    low = text.lower()
    n = max(1, len(low.split()))
    return [*fixed_features(text, low), *(c / n for c in gram_counts(low, grams))]


def fragments(text: str) -> dict[str, int]:
    """Counts of words and of the pieces of SIZES letters of words."""
    out: Counter[str] = Counter()
    for w, c in Counter(text.lower().split()).items():
        w = w.strip("!?.,;:\"'()#&%$*|")
        some = {w} if 3 <= len(w) <= 12 else set()
        for k in SIZES:
            some.update(w[i : i + k] for i in range(len(w) - k + 1))
        for g in some:
            out[g] += c
    return out


def _per_fold(docs: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """gram, and for each fold n, s and q: in how many rows (text, fold) a fragment is, and sums of its density and its
    square. keep: fragments (gram) that alone are looked at."""

    def out(sums: dict[tuple[str, int], list[float]]) -> pa.RecordBatch:
        vals = zip(*sums.values(), strict=True) if sums else ((), (), ())
        cols = [pa.array([k[i] for k in sums], t) for i, t in enumerate([pa.string(), pa.int32()])]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(v, t) for v, t in zip(vals, [pa.int64(), pa.float64(), pa.float64()], strict=True))], names=["gram", "fold", "n", "s", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[float]] = {}
        for b in batches:
            for i in range(b.num_rows):
                t, fold = (b.column(c)[i].as_py() for c in range(2))
                n = max(1, len(t.split()))
                for g, c in fragments(t).items():
                    x = sums.setdefault((g, fold), [0, 0.0, 0.0])
                    x[0] += 1
                    x[1] += c / n
                    x[2] += (c / n) ** 2
                if len(sums) > HELD:
                    yield out(sums)
                    sums = {}
        yield out(sums)

    found = docs.select("text", "fold").mapInArrow(run, "gram string, fold int, n long, s double, q double")
    if keep is not None:
        found = found.join(F.broadcast(keep), "gram", "left_semi")
    return found.groupBy("gram").agg(*(F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in "nsq"))


def fragment_sums(sample: DataFrame) -> DataFrame:
    """gram, and for labels 1 and 0 and each fold the sums of _per_fold as columns like n1_0. Only fragments of three rows
    of label 1 or more: as the sample is bounded, so are these, and they are broadcast to the rows of label 0."""
    named = lambda x, y: x.toDF(*(f"{c[0]}{y}_{c[1:]}" if c != "gram" else c for c in x.columns))
    ones = _per_fold(sample.where("label = 1"))
    ones = checkpoint(ones.where(sum(F.col(f"n{k}") for k in range(FOLDS)) >= 3).coalesce(8))
    zeros = _per_fold(sample.where("label = 0"), ones.select("gram"))
    return checkpoint(named(ones, 1).join(named(zeros, 0), "gram", "left").na.fill(0).coalesce(8))


def choose_grams(sums: DataFrame, without: int, n1: int, n0: int, count: int = GRAMS) -> tuple[str, ...]:
    """The fragments whose densities tell the labels apart best in all folds but one, by Welch's t; of fragments one of
    which contains the other, the better."""
    total = lambda c: sum(F.col(f"{c}_{k}") for k in range(FOLDS) if k != without)
    t = sums.select("gram", *(total(f"{c}{y}").alias(f"{c}{y}") for c in "nsq" for y in (0, 1))).where(F.col("n1") >= max(3, n1 // 100))
    m1, m0 = F.col("s1") / n1, F.col("s0") / n0
    var = (F.col("q1") / n1 - m1 * m1) / n1 + (F.col("q0") / n0 - m0 * m0) / n0
    best = t.withColumn("t", (m1 - m0) / F.sqrt(F.greatest(var, F.lit(1e-18)))).where("t > 3").orderBy(F.desc(F.round("t", 1)), F.desc(F.length("gram")), "gram").limit(40 * count).select("gram").collect()
    out: list[str] = []
    for r in best:
        if len(out) < count and not any(g in r.gram or r.gram in g for g in out):
            out.append(r.gram)
    return tuple(out)


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features; all arrays are small."""

    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)  # by tree: the split of each inner node
    split: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1) if len(self.cuts) else np.zeros((len(x), 0), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.bins(x), np.full(len(x), self.base), np.arange(len(x))
        for f, s, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                at = 2 * at + 1 + (b[rows, f[at]] > s[at])
            out += leaf[at - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.1, l2: float = 2.0, least: float = 4.0, bins: int = 64) -> Trees:
    """Newton boosting of the logistic loss. least: of hessian in a leaf, so that few rows alone make no leaf."""
    m = Trees([np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])])
    p = y.mean().clip(1e-6, 1 - 1e-6)
    m.base = float(np.log(p / (1 - p)))
    b, d = m.bins(x), x.shape[1]
    flat = b + np.arange(d) * bins
    margin = np.full(len(x), m.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        inner = (1 << depth) - 1
        feat, split, at = np.zeros(inner, np.int64), np.full(inner, bins), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((at - first)[:, None] * (d * bins) + flat).ravel()
            gs, hs = (np.bincount(cell, np.repeat(v, d), width * d * bins).reshape(width, d, bins) for v in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            top = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feat[first : first + width] = np.where(top, best // bins, 0)
            split[first : first + width] = np.where(top, best % bins, bins)
            at = 2 * at + 1 + (b[np.arange(len(x)), feat[at]] > split[at])
        of = at - inner
        leaf = rate * np.bincount(of, g, 1 << depth) / (np.bincount(of, h, 1 << depth) + l2)
        margin += leaf[of]
        m.feature.append(feat)
        m.split.append(split)
        m.leaf.append(leaf)
    return m


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone least-squares fit of y to score, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + z for a, z in zip(blocks[-1], last, strict=True)]
    return np.array([s / n for _, n, s in blocks]), np.array([v / n for v, n, _ in blocks])


def columns(grams: tuple[str, ...], own: tuple[str, ...], x: np.ndarray) -> np.ndarray:
    """Of features with the densities of grams those that a model with own fragments looks at, and the sum of these."""
    place = {g: k for k, g in enumerate(grams)}
    dense = x[:, [len(FIXED) + place[g] for g in own]]
    return np.concatenate([x[:, : len(FIXED)], dense, dense.sum(1, keepdims=True)], 1)


@dataclass
class Model:
    grams: tuple[str, ...]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]
    share: float | None = None  # of label 1, where there is nothing to learn

    def score(self, some: list[str]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(some), self.share)
        if not some:
            return np.empty(0)
        x = np.array([features(t, self.grams) for t in some])
        return np.interp(self.trees.margin(columns(self.grams, self.grams, x)), *self.knots)


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, grams: tuple[str, ...], chosen: list[tuple[str, ...]]) -> Model:
    """x: features with the densities of grams; chosen: the fragments of each fold, chosen without it, and last those of all
    rows."""
    out = np.full(len(y), np.nan)
    for k in np.unique(fold):
        mine, rest = fold == k, fold != k
        if len(np.unique(y[rest])) == 2:
            seen = columns(grams, chosen[k], x)
            out[mine] = fit_trees(seen[rest], y[rest]).margin(seen[mine])
    trees = fit_trees(columns(grams, chosen[-1], x), y)
    known = ~np.isnan(out)
    if len(np.unique(y[known])) < 2:  # equal texts alone: nothing is out of fold
        out, known = trees.margin(columns(grams, chosen[-1], x)), np.ones(len(y), bool)
    return Model(chosen[-1], trees, isotonic(out[known], y[known]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, gram_rows: int = GRAM_ROWS) -> Model:
    """docs: id and text; labels: id and label. The sample is the labelled rows with the least hashes of
    their ids; the first gram_rows of them choose the fragments."""
    label = quoted(label_col)
    known = labels.where(label.isin(0, 1) & quoted(id_col).isNotNull()).select(quoted(id_col).alias("id"), label.cast("int").alias("label"))
    # A bounded number of ids and labels, ordered by hash: it is made once, so every use sees the same sample.
    rows = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows).collect()
    some = docs.sparkSession.createDataFrame([(r.id, r.label, k < gram_rows) for k, r in enumerate(rows)], T.StructType([T.StructField("id", known.schema["id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("first", T.BooleanType())]))
    sample = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text")).join(F.broadcast(some), "id").select("text", "label", "first")
    # Equal texts are in one fold.
    sample = checkpoint(sample.withColumn("fold", F.pmod(F.xxhash64(F.lower("text")), F.lit(FOLDS)).cast("int")))
    n = {(r.label, r.fold): (r.n, r.g) for r in sample.groupBy("label", "fold").agg(F.count("*").alias("n"), F.count_if("first").alias("g")).collect()}
    if len({label for label, _ in n}) < 2:
        return Model((), Trees(), (np.zeros(1), np.zeros(1)), float(next((label for label, _ in n), 0)))
    sums, chosen = fragment_sums(sample.where("first")), []
    for k in range(FOLDS + 1):  # last: of all rows
        n1, n0 = (sum(g for (a, f), (_, g) in n.items() if a == label and f != k) for label in (1, 0))
        chosen.append(choose_grams(sums, k, n1, n0) if n1 and n0 else ())
    grams = tuple(sorted(set().union(*chosen)))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([np.array(features(t, grams)).tobytes() for t in texts(b)], pa.binary())], names=["label", "fold", "x"])

    rows = sample.select("text", "label", "fold").mapInArrow(by_row(run, 64), "label int, fold int, x binary").toArrow()
    x, y, fold = np.frombuffer(b"".join(rows.column("x").to_pylist())).reshape(rows.num_rows, -1), rows.column("label").to_numpy().astype(float), rows.column("fold").to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the rows come in any order; the fit must not depend on it
    return fit(x[order], y[order], fold[order], grams, chosen)


def score_texts(df: DataFrame, model: Model, keep: tuple[str, ...] = (), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns in keep and the score of each row."""
    return map_texts(df, keep, F.coalesce(quoted(text_col), F.lit("")), [(score_col, T.DoubleType())], lambda x: [pa.array(model.score(x.to_pylist()), pa.float64())], rows=256)


def learned_from(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of labels that are not held out."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learned_from(read(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_texts(docs, model, ("doc_id",)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
