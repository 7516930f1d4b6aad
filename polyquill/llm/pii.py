"""Personal data by candidate boosting, in DataFrame and SQL functions alone.

Base spans (e-mail, IPv4, payment card, phone) are found by four patterns and a check of each match.  High-recall
generators propose further spans, which may overlap: dotted or spelled-out e-mail addresses, phone numbers
without a country code, card numbers with other separators, addresses with a port.  Gradient-boosted trees score every
candidate by its format and context; per kind, the threshold is the least one with no false selection on
half of the labelled table that the trees haven't seen.  Selected candidates join the base spans where they overlap
neither those nor a better candidate.

The labelled table is generated from fixed templates, so its size is fixed.  Training sees it through the same
expressions as documents; the trees become CASE expressions.  Executors run no Python.

A text may have very many matches: they are numbered in chunks, pieces of the text come from blocks of ``BLOCK`` characters, and
overlaps are found by binary search in the sorted spans of each kind.

Defined results: null and empty texts have no spans; repeated rows, and rows with a null doc_id, are treated alike; positions count code
points; of two overlapping candidates the one with the greater score stays, of equal scores the earlier, then the longer, then that
of the kind listed first; an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_names

KINDS = ["email", "ip", "card", "phone"]
#: A noncharacter that marks matches; in texts it is read as U+FFFD, which no pattern matches either.
_MARK, _OTHER = "﷐", "�"
# Possessive and anchored forms of the contract's patterns: the same matches, without recursion or restarts inside a run.
_BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", None),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
_MORE = {
    "email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63} ?(?:@|\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[a-z0-9-]{1,63}){1,4}", r"(?i)[(\[ ]at[)\] ]|@"),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?+(?![0-9])", r"[0-9]\.[0-9]"),
    "card": (r"(?<![0-9])[0-9]{4}([ ._/-]{1,2})[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,4})?+(?![0-9])", r"[0-9]{4}[ ._/-]"),
    "phone": (r"(?<![0-9A-Za-z+])(?:\(?00[0-9]{1,3}\)?[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4})?+(?![0-9A-Za-z])", r"[0-9]{3}[) .-]"),
}


#: Elements of an array that are folded at once, and characters in a block of text.
_CHUNK, BLOCK = 64, 512


def _bound(value: Column, f) -> Column:
    """f(value), with the value computed once, also where f is a lambda over many elements."""
    return F.transform(F.array(value), f)[0]


def _scanned(items: Column, zero: Column, add, merge, local) -> Column:
    """local(chunk, carry) of each chunk of the items, flattened; the carry is what ``add`` makes of all items before the chunk.
    An accumulator is copied at each step, so none here holds more than a chunk's results."""

    def over(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / _CHUNK).cast("int") - 1, F.lit(0)))
        chunk = lambda c: F.slice(xs, c * _CHUNK + 1, F.lit(_CHUNK))
        sums = F.transform(numbers, lambda c: F.aggregate(chunk(c), zero, add))
        return _bound(sums, lambda s: F.flatten(F.transform(numbers, lambda c: local(chunk(c), F.aggregate(F.slice(s, F.lit(1), c), zero, merge)))))

    return _bound(items, over)


def _matches(t: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the pattern's matches in t, which holds no mark."""
    parts = F.split(F.regexp_replace(t, pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def local(chunk: Column, before: Column) -> Column:  # chunks are of even size, so matches are at odd places
        start = F.struct(before.alias("p"), F.lit(0).alias("i"), F.array().cast(_NONE).alias("a"))

        def step(acc: Column, x: Column) -> Column:
            end = acc["p"] + F.length(x)
            found = F.struct(acc["p"].alias("s"), end.alias("e"), x.alias("m"))
            return F.struct(end.alias("p"), (acc["i"] + 1).alias("i"), F.when(acc["i"] % 2 == 1, F.array_append(acc["a"], found)).otherwise(acc["a"]).alias("a"))

        return F.aggregate(chunk, start, step, lambda acc: acc["a"])

    return _scanned(parts, F.lit(0), lambda a, x: a + F.length(x), lambda a, x: a + x, local)


def _blocks(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _range(blocks: Column, begin: Column, end: Column) -> Column:
    """The characters from begin to end (exclusive), without a walk from the text's start."""
    size = F.lit(BLOCK)

    def part(i: Column) -> Column:
        low = F.greatest(begin - i * size, F.lit(0))
        return F.substring(F.get(blocks, i), low + 1, F.least(end - i * size, size) - low)

    some = F.sequence(F.floor(begin / size).cast("int"), F.floor((end - 1) / size).cast("int"))
    return F.when(end > begin, F.array_join(F.transform(some, part), "")).otherwise("")


def _under(spans: Column, field: str, limit: Column) -> Column:
    """How many of the spans, which are sorted by the field, have it under the limit: a binary search."""
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(spans) + 1)).cast("int"), F.lit(1)))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        low = (a["lo"] < a["hi"]) & (F.get(spans, mid)[field] < limit)
        return F.struct(F.when(low, mid + 1).otherwise(a["lo"]).alias("lo"), F.when((a["lo"] < a["hi"]) & ~low, mid).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), step, lambda a: a["lo"])


def _overlapping(spans: Column, x: Column) -> Column:
    """Those of the spans, which are sorted and don't overlap each other, that overlap x."""
    first = _under(spans, "e", x["s"] + 1)
    return F.slice(spans, first + 1, F.greatest(_under(spans, "s", x["e"]) - first, F.lit(0)))


def _best(kinds: Column) -> Column:
    """The spans (s, k, e, v), one array for each kind, but for those that overlap a better one of any kind."""
    key = lambda x: F.struct(x["v"], -x["s"], x["e"], -x["k"])
    beaten = lambda x, by: F.exists(by, lambda spans: F.exists(_overlapping(spans, x), lambda o: key(o) > key(x)))
    return _bound(kinds, lambda by: F.flatten(F.transform(by, lambda own: F.filter(own, lambda x: ~beaten(x, by)))))


_NONE = "array<struct<s:int,e:int,m:string>>"


def _when_any(t: Column, cue: str | None, found: Column) -> Column:
    test = t.rlike("[0-9]") if cue is None else F.instr(t, cue) > 0 if len(cue) == 1 else t.rlike(cue)
    return F.when(test, found).otherwise(F.array().cast(_NONE))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether a string of 1 to 40 digits passes."""

    def one(i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + one(i)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.length(z := F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(z) <= 3, z).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    d = _digits(m)
    n = F.length(d)
    return n.between(10, 15) if kind == "phone" else F.when(n.between(14, 19), _luhn(d)).otherwise(False)


# Lambdas of higher-order functions may take an index as a second argument, so kinds are bound here and not as defaults.
def _passing(kind: str):
    return lambda x: _passes(kind, x["m"])


def _span(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def _prepared(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _MARK, _OTHER)


def base_spans(t: Column) -> Column:
    """An array for each kind of its array<struct<s, k, e>>, sorted by start."""
    each = []
    for k, kind in enumerate(KINDS):
        pattern, cue = _BASE[kind]
        good = F.filter(_matches(t, pattern), _passing(kind))
        each.append(F.transform(_when_any(t, cue, good), _span(k)))
    return F.array(*each)


_CUES = {
    "mail": r"(?i)mail|write|contact|reach", "tel": r"(?i)phone|tel|call|fax|mobile|whatsapp", "net": r"(?i)\bip\b|host|server|addr|login", "pay": r"(?i)card|visa|master|pay|acct",
    "not": r"(?i)order|invoice|ref|version|\bv|isbn|serial|part|meet|look|date|case|no\.|#",
}
FEATURES = ["k", "len", "digits", "distinct", "seps", "luhn", "octets", "tld", "spelled", "paren", "left", "right", *(f"cue_{c}" for c in _CUES)]


def _features(blocks: Column, x: Column) -> list[Column]:
    """Format and context of a candidate; blocks: those of its text."""
    m, d, k = x["m"], _digits(x["m"]), x["k"]
    before = _range(blocks, F.greatest(x["s"] - 24, F.lit(0)), x["s"])
    left, right = F.right(before, F.lit(1)), _range(blocks, x["e"], x["e"] + 1)
    is_ = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        k.cast("double"), F.length(m).cast("double"), F.length(d).cast("double"), F.array_size(F.array_distinct(F.split(d, ""))).cast("double"), F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"),
        is_(F.length(d).between(12, 19) & _luhn(F.when(F.length(d).between(12, 19), d).otherwise("0"))), is_((k == 1) & _passes("ip", F.regexp_replace(m, ":.*", ""))),
        is_(m.rlike(r"(?:\.|(?i:dot)[)\]]? ?)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$")), is_(m.rlike(r"(?i)[(\[](?:at|dot)[)\]]|@")), is_(m.rlike(r"^\([0-9]{3}\)")),
        is_(left.rlike("[A-Za-z0-9/_#=.-]")), is_(right.rlike("[A-Za-z0-9/_=-]")), *(is_(before.rlike(c)) for c in _CUES.values()),
    ]


_CANDIDATE = "struct<s:int,k:int,e:int,f:array<double>>"


def _proposal(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"))


def candidates(t: Column, base: Column) -> Column:
    """An array for each kind of its array<struct<s, k, e, f>>: what the generators propose apart from the base spans, with features f."""
    each = [F.transform(_when_any(t, cue, _matches(t, pattern)), _proposal(k)) for k, (pattern, cue) in enumerate(_MORE[kind] for kind in KINDS)]

    def described(found: Column) -> Column:
        apart = lambda x: ~F.exists(base, lambda spans: F.size(_overlapping(spans, x)) > 0)
        one = lambda blocks: lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.array(*_features(blocks, x)).alias("f"))
        return _bound(_blocks(t), lambda blocks: F.transform(found, lambda own: F.transform(F.filter(own, apart), one(blocks))))

    return _bound(F.array(*each), lambda found: F.when(F.exists(found, lambda own: F.size(own) > 0), described(found)).otherwise(F.array().cast(f"array<array<{_CANDIDATE}>>")))


def labelled_table(seed: int = 7) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, kind, label) from templates: each text has one span that is personal data (1) or only looks so (0)."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(3, 9)))

    def card(n: int, valid: bool) -> str:
        d = num(n - 1)
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
        return d + str((-total + (0 if valid else r.randint(1, 9))) % 10)

    def grouped(d: str, s: str) -> str:
        return s.join(d[i : i + 4] for i in range(0, len(d), 4))

    out = []
    for _ in range(110):
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", ".")])
        tld = r.choice(["com", "org", "net", "de", "fr"])
        options = [
            (r.choice(["Phone: ", "call ", "Tel. ", "mobile "]), r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]), 3, 1),
            (r.choice(["or ", "at the desk ", ""]), f"({num(3)}) {num(3)}-{num(4)}", 3, 1),
            (r.choice(["order ", "invoice ", "part no. ", "version ", "case #", "ref "]), r.choice([f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(3)}"]), 3, 0),
            (r.choice(["about ", "of ", "and "]), f"{num(3)} {num(3)} {num(3)}", 3, 0),
            (r.choice(["mail ", "write to ", "contact ", ""]), f"{word()}{at}{word()}{dot}{tld}", 0, 1),
            (r.choice(["we meet ", "look ", "they sat ", ""]), f"{word()} at {word()}.{word().capitalize()}", 0, 0),
            (r.choice(["look ", "and ", ""]), f"{word()} at {word()}. {word().capitalize()}", 0, 0),
            (r.choice(["card ", "paid with visa ", "pay "]), grouped(card(16, True), r.choice([".", "_", "/", "  "])), 2, 1),
            (r.choice(["serial ", "ref ", "isbn ", "and "]), grouped(card(16, False), r.choice([".", "_", "/", "  "])), 2, 0),
        ]
        for lead, span, kind, label in options:
            text = f"{word()} {lead}{span} {word()}"
            s = text.index(lead + span) + len(lead)
            out.append((text, s, s + len(span), kind, label))
    return out


def _boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.35, least: int = 4) -> tuple[float, list]:
    """Logistic gradient boosting of small regression trees; a tree is a leaf value or (feature, cut, left, right)."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, d: int):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        best, gain = None, 1e-6
        if d:
            for j in range(x.shape[1]):
                values = np.unique(x[rows, j])
                for cut in (values[:-1] + values[1:]) / 2:
                    low = x[rows, j] <= cut
                    if low.sum() < least or (~low).sum() < least:
                        continue
                    a, b = rows[low], rows[~low]
                    new = sum(g[i].sum() ** 2 / (h[i].sum() + 1.0) for i in (a, b)) - g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
                    if new > gain:
                        best, gain = (j, float(cut), a, b), new
        return leaf if best is None else (best[0], best[1], grow(best[2], g, h, d - 1), grow(best[3], g, h, d - 1))

    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(tree := grow(np.arange(len(y)), y - p, p * (1 - p), depth))
        score = score + _predict(tree, x)
    return base, trees


def _predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    return np.where(low, _predict(tree[2], x), _predict(tree[3], x))


def _tree_column(tree, f: Column) -> Column:
    return F.lit(tree) if not isinstance(tree, tuple) else F.when(f[tree[0]] <= tree[1], _tree_column(tree[2], f)).otherwise(_tree_column(tree[3], f))


def train(spark: SparkSession) -> tuple[float, list, list[float]]:
    """The boosted trees and the threshold of each kind."""
    rows = labelled_table()
    values = ",".join("('" + text.replace("\\", "\\\\").replace("'", "\\'") + f"',{s},{e},{k},{y})" for text, s, e, k, y in rows)
    table = spark.sql(f"select * from values {values} as v(text, s0, e0, k0, y)")
    t = _prepared(F.col("text"))
    found = table.select("s0", "e0", "k0", "y", F.explode(F.flatten(candidates(t, base_spans(t)))).alias("c"))
    found = found.select((F.when((F.col("c.k") == F.col("k0")) & (F.col("c.s") == F.col("s0")) & (F.col("c.e") == F.col("e0")), F.col("y")).otherwise(F.when((F.col("c.s") >= F.col("e0")) | (F.col("c.e") <= F.col("s0")) | (F.col("y") == 0), 0))).alias("y"), "c.k", "c.f").where("y is not null")
    got = found.orderBy(F.xxhash64("f"), "y").collect()  # at most a few spans of each row of a fixed table
    x, y, k = np.array([r.f for r in got]), np.array([r.y for r in got], float), np.array([r.k for r in got])
    fit, held = np.arange(len(y)) % 2 == 0, np.arange(len(y)) % 2 == 1
    base, trees = _boost(x[fit], y[fit])
    score = base + sum(_predict(t, x[held]) for t in trees)
    cut = [float(max([0.0, *score[(k[held] == j) & (y[held] == 0)]])) + 0.25 for j in range(len(KINDS))]
    return base, trees, cut


def with_spans(docs: DataFrame, model: tuple[float, list, list[float]], text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two arrays of spans struct<s, k, e>, and their names (new ones, whatever docs has): the base spans, and those with the selected candidates."""
    start, trees, cut = model
    base, out, t, by_kind, c = free_names(docs.columns, "_base", "_spans", "_t", "_k", "_c")
    d = docs.withColumn(t, _prepared(F.col(text)))
    d = d.withColumn(by_kind, base_spans(F.col(t)))
    d = d.withColumn(c, candidates(F.col(t), F.col(by_kind)))
    limits = F.array(*(F.lit(v) for v in cut))

    def scored(x: Column) -> Column:
        value = reduce(lambda a, b: a + b, [_tree_column(tree, x["f"]) for tree in trees], F.lit(start))
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), value.alias("v"))

    selected = F.transform(F.col(c), lambda own: F.filter(F.transform(own, scored), lambda x: x["v"] >= F.get(limits, x["k"])))
    d = d.withColumn(c, F.when(F.size(c) > 0, _best(selected)))
    chosen = F.transform(F.col(c), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    d = d.withColumn(base, F.array_sort(F.flatten(by_kind)))
    d = d.withColumn(out, F.when(F.size(c) > 0, F.array_sort(F.concat(F.col(base), chosen))).otherwise(F.col(base)))
    return d.drop(c, t, by_kind), base, out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by [KIND] of its first; null stays null."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    further = lambda p, x: F.greatest(p, x["e"])

    def whole(blocks: Column) -> Column:
        def local(chunk: Column, before: Column) -> Column:
            start = F.struct(before.alias("p"), F.array().cast("array<string>").alias("a"))

            def step(acc: Column, x: Column) -> Column:
                new = F.concat(_range(blocks, acc["p"], x["s"]), F.get(names, x["k"]))
                return F.struct(further(acc["p"], x).alias("p"), F.when(x["s"] >= acc["p"], F.array_append(acc["a"], new)).otherwise(acc["a"]).alias("a"))

            return F.aggregate(chunk, start, step, lambda acc: acc["a"])

        pieces = _scanned(spans, F.lit(0), further, lambda a, b: F.greatest(a, b), local)
        tail = _range(blocks, F.aggregate(spans, F.lit(0), further), F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    return F.when(F.size(spans) > 0, _bound(_blocks(text), whole)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    d, base, spans = with_spans(docs.select("doc_id", "text"), train(docs.sparkSession))
    count = lambda k: F.size(F.filter(base, lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return d.select("doc_id", *(count(k) for k in range(4)), F.sha2(joined(F.col(base)), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))
