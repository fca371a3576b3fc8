r"""Quality rules: a decision list learned by sequential covering, emitted as Spark conditions.

``statistics`` measures every whole text.  ``learn`` grows conjunctions of
thresholds by information gain on two thirds of the labelled rows, prunes each
on the last third, and stops when a rule no longer holds there.  The list is
ordered; ``DecisionList.column`` turns it into one nested Spark conditional.

Only the fit is on a bounded sample: at most ``MAX_LABELLED`` labelled rows, those
with the smallest hash of doc_id.  Rows without a label, or with more than one
opinion, take no part in it.  Verdicts are over all rows.

Nulls: a null text has no words and fails the base rule.  A null doc_id is kept
as it is and never labelled.  Empty tables give empty results; without labels
of both kinds the list is empty and keeps everything that passes the base rule.
Repeated rows are judged each for itself.  ``keep`` returns every column as it
was, whatever its name; ``statistics`` and ``judge`` add columns and refuse a kept
one of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of the base statistic, fixed value.
SYMBOLS = b"#*$%&|<>"
#: Bound of the labelled sample, in rows.
MAX_LABELLED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: n_distinct adds up the different words of each block of so many, since the
#: share of different words in a whole text falls with its length.
BLOCK_WORDS = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
#: ASCII marks that are none of the symbols.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS)


def count_text(text: bytes) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text in UTF-8."""
    words = text.split()
    n = len(words)
    chars = len(text.decode())
    without = len(text) - len(text.translate(None, common.WHITE))
    lines = [x for x in text.split(b"\n") if x.strip(common.WHITE)]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeat = 0
    if n > 3:
        size = len(known)
        pair = ids[:-1] * size + ids[1:]
        # two steps, so that three ids always fit
        _, pair = np.unique(pair, return_inverse=True) if size > 2_000_000 else (None, pair)
        key = pair[:-1] * size + ids[2:] if size < 2_000_000 else np.unique(np.stack([pair[:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if same.any():
            twice = np.zeros(len(key) + 2, bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            for k in range(3):
                twice[at + k] = True
            repeat = int(twice.sum())
    count = lambda table: len(text) - len(text.translate(None, table))
    distinct = len(np.unique(np.arange(n) // BLOCK_WORDS * max(1, len(known)) + ids))
    return (n, chars - without, count(SYMBOLS), len(lines) - len(set(lines)), repeat, chars, len(lines), count(_UPPER), count(_DIGITS), count(_MARKS), distinct)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), mark: str = "s_") -> DataFrame:
    """The counts of every text, under ``mark`` and their names, beside the columns ``keep``."""
    kept = [f for f in docs.schema.fields if f.name in keep]
    names = [f"{mark}{c}" for c in COUNTS]
    clash = {n.lower() for n in names} & {f.name.lower() for f in kept}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already; choose another mark")
    own = any(f.name == "text" and f.dataType.simpleString() == "string" for f in kept)
    source_name = "text" if own else common.fresh(docs, f"{mark}text")

    def step(batches):
        for batch in batches:
            for rows in common.slices(batch, source_name):
                found = np.array([count_text(t) for t in common.utf8(rows.column(source_name))], np.int64).reshape(-1, len(COUNTS))
                columns = [rows.column(f.name) for f in kept] + [pa.array(found[:, i]) for i in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + names)

    extra = [] if own else [F.col("text").cast("string").alias(source_name)]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], *extra)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` long" for n in names])
    return common.map_batches(source, step, schema)


def _per(a: str, b: str, mark: str) -> Column:
    return F.col(f"{mark}{a}") / F.greatest(F.col(f"{mark}{b}"), F.lit(1))


#: Features that rules may test: all shares, so that a text's length alone never rejects it.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "n_chars"),
    "upper_share": ("n_upper", "n_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "mean_word": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature_columns(mark: str = "s_") -> dict[str, Column]:
    return {k: _per(*v, mark) for k, v in FEATURES.items()}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.limit if self.above else x[self.feature] <= self.limit

    def column(self, features: dict[str, Column]) -> Column:
        c = features[self.feature]
        return c > F.lit(self.limit) if self.above else c <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, none keeps."""

    rules: list[list[Test]] = field(default_factory=list)

    def column(self, features: dict[str, Column] | None = None) -> Column:
        """1-based number of the first rule that holds, 0 for none: one nested conditional."""
        features = features or feature_columns()
        chosen = None
        for i, rule in enumerate(self.rules, 1):
            holds = rule[0].column(features)
            for t in rule[1:]:
                holds = holds & t.column(features)
            chosen = F.when(holds, i) if chosen is None else chosen.when(holds, i)
        return F.lit(0) if chosen is None else chosen.otherwise(0)

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values()))) if x else 0
        out = np.zeros(n, np.int64)
        for i, rule in enumerate(self.rules, 1):
            holds = np.logical_and.reduce([t.mask(x) for t in rule])
            out[holds & (out == 0)] = i
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules)


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray) -> tuple[float, Test | None]:
    """The threshold with the largest gain in bits over the rows ``live``."""
    p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, Test | None] = (0.0, None)
    for name, values in x.items():
        v = values[live]
        order = np.argsort(v, kind="stable")
        v, b = v[order], bad[live][order]
        cut = np.flatnonzero(v[1:] != v[:-1])
        if not len(cut):
            continue
        p_low, n_low = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        limit = (v[cut] + v[cut + 1]) / 2
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Test(name, above, float(limit[i])))
    return best


def _worth(rule: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    """Value of a rule on held-out rows: (caught - wrong) / (caught + wrong)."""
    holds = np.logical_and.reduce([t.mask(x) for t in rule])
    p, n = int((holds & bad).sum()), int((holds & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7, max_rules: int = 16, max_tests: int = 4, min_caught: int = 3, precision: float = 0.95) -> DecisionList:
    """Sequential covering: grow, prune, keep while a rule is precise on the rows it was not grown on."""
    out = DecisionList()
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    for _ in range(max_rules):
        rows = rng.permutation(np.flatnonzero(left))
        cut = len(rows) * 2 // 3
        grow, prune = rows[:cut], rows[cut:]
        gx, px = ({k: v[i] for k, v in x.items()} for i in (grow, prune))
        gb, pb = bad[grow], bad[prune]
        live, rule = np.ones(len(grow), bool), []
        while len(rule) < max_tests and gb[live].any() and (~gb[live]).any():
            _, test = _best_test(gx, gb, live)
            if test is None:
                break
            rule.append(test)
            live &= test.mask(gx)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, px, pb))
        holds = np.logical_and.reduce([t.mask(px) for t in rule])
        caught, wrong = int((holds & pb).sum()), int((holds & ~pb).sum())
        if caught < min_caught or caught < precision * (caught + wrong):
            break
        out.rules.append(rule)
        left &= ~np.logical_and.reduce([t.mask(x) for t in rule])
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and labels (True: bad) of at most ``max_labelled`` labelled documents."""
    clear = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("__q"), F.max("quality").alias("__top"))
    few = clear.where("__q = __top").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", "__q")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")
    found = statistics(texts, ("doc_id", "__q")).select("doc_id", "__q", *[c.alias(k) for k, c in feature_columns().items()])
    # one row a doc_id, in its order: the same list every time
    rows = found.groupBy("doc_id").agg(F.min("__q").alias("__q"), *[F.min(k).alias(k) for k in FEATURES]).toPandas().sort_values("doc_id")
    return {k: rows[k].to_numpy(np.float64) for k in FEATURES}, rows["__q"].to_numpy() == 0


def base_failed(mark: str = "s_") -> Column:
    words, repeated = F.col(f"{mark}n_words"), F.col(f"{mark}n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """The decision list of the labelled documents."""
    x, bad = labelled_sample(docs, labels, max_labelled)
    if not bad.any() or bad.all():
        return DecisionList()
    return learn(x, bad)


def judge(docs: DataFrame, rules: DecisionList, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, ``base_failed``, number of the ``rule`` that holds, and verdict ``kept`` of every document."""
    clash = {"base_failed", "rule", "kept"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    found = statistics(docs, keep)
    return found.withColumn("base_failed", base_failed()).withColumn("rule", rules.column()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that stay, with all their columns."""
    mark = "s_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    found = statistics(docs, tuple(docs.columns), mark)
    stays = ~base_failed(mark) & (rules.column(feature_columns(mark)) == 0)
    return found.where(stays).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by rules learned from the labels."""
    docs = common.table(spark, sf_dir, "documents")
    rules = fit(docs, common.table(spark, sf_dir, "labels"))
    found = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *[F.col(f"s_{c}").alias(c) for c in counts], "base_failed", "kept", "rule")
