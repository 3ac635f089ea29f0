"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds; SQL functions only.

The base rules (pattern and validity check of each kind) always count. Wider patterns propose further spans in what the
base rules leave of a text. Trees learn from features that do not depend on how a span is written (no plus sign, no at
sign, no separators): base matches are the positive examples, candidates that no reading makes sound (too many digits, a
failing check sum, octets over 255) the negative ones, and a fixed prior spread over all features stands in where a
corpus has few. Sound candidates in other forms have no label; they are what the trees decide. The corpus is reduced to
counts per combination of features, whose number is bounded, and only those reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneloom.llm.quality import Trees, fit_trees
from zoneloom.llm.rules import let
from zoneloom.llm.tables import free_name
from zoneloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH = 40, 4
PRECISION = 0.95  # of a kind's labelled candidates above its threshold so many are positive
PRIOR = 200.0  # candidates that the prior counts for, per kind and label
CONTEXT = 24

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# A run of local-part characters is tried at its start or where the last match ended: elsewhere it fares no better.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))

# Wider forms: written-out signs, ports and hexadecimal groups, other separators, no plus sign.
WIDE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++[\x20]?(?:@|\(at\)|\[at\])[\x20]?[{_LABEL}]++(?:[\x20]?(?:\.|\(dot\)|\[dot\])[\x20]?[{_LABEL}]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{1,5}|(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{1,5}\)?(?:[\x20()./-]{0,2}[0-9]){6,14}(?![0-9])",
}
# Forms with set groups, looked for ahead of the wide ones, so that neighbouring numbers do not run together.
GROUPED = {
    "card": r"(?<![0-9])[0-9]{4}([\x20._/-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?1[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
DATE = r"^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9])"
# What a text has to contain before a pattern is tried.
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9][.:][0-9A-Fa-f]|:[0-9A-Fa-f]*:", "card": "[0-9]", "phone": "[0-9]"}
KEYWORDS = {
    "email": "mail|contact|write to|adresse", "ip": "ip|host|server|address|client|login", "card": "card|visa|amex|credit|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobil|ring|whatsapp",
}
# How many values each feature takes. Digits: too few, as many as the kind has, too many. Groups: one, two
# to five, more. Sound: whether the kind's check holds of some reading. Keyword: whether one stands before. Before, after:
# white space or an end, letter or digit, other.
FEATURES = {"digits": 3, "groups": 3, "sound": 2, "keyword": 2, "before": 3, "after": 3}


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _sums_before(lengths: Column, block: int = 64) -> Column:
    """Sum of the lengths before each place, in blocks so that long arrays take no quadratic time."""
    def in_blocks(ls: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(ls) / block).cast("int") - 1)
        part = lambda b: F.slice(ls, b * block + 1, block)
        of_blocks = F.transform(numbers, lambda b: _total(part(b)))
        starts = let(of_blocks, lambda s: F.transform(s, lambda _, b: _total(F.slice(s, F.lit(1), b))))
        return F.flatten(let(starts, lambda s: F.transform(numbers, lambda b: let(part(b), lambda p: F.transform(p, lambda _, i: s[b] + _total(F.slice(p, F.lit(1), i)))))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, in_blocks))


MATCH = "array<struct<start:int,stop:int,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches: first and last place in code points (end exclusive), text, and what stands around."""
    def located(parts: Column) -> Column:
        def placed(gaps: Column, found: Column, before: Column) -> Column:
            return F.transform(found, lambda m, k: F.struct(
                (before[k] + F.length(gaps[k])).alias("start"), (before[k] + F.length(gaps[k]) + F.length(m)).alias("stop"), m.alias("match"),
                F.right(gaps[k], F.lit(CONTEXT)).alias("before"), F.left(gaps[k + 1], F.lit(1)).alias("after"),
            ))

        lengths = F.transform(parts["found"], lambda m, k: F.length(m) + F.length(parts["gaps"][k]))
        return let(_sums_before(lengths), lambda before: placed(parts["gaps"], parts["found"], before))

    pair = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(needs), let(pair, located)).otherwise(F.array().cast(MATCH))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum holds: from the right every second digit is doubled, less 9 if that is over 9."""
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    step = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    return _total(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), step)) % 10 == 0


def _octets(match: Column) -> Column:
    """Whether the dotted numbers are at most 255."""
    return F.forall(F.split(F.split(match, ":")[0], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255))


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return _octets(match)
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _around(character: Column) -> Column:
    return F.when(F.length(character) == 0, 0).when(character.rlike(r"[\x20\x09-\x0D]"), 0).when(character.rlike("[A-Za-z0-9]"), 1).otherwise(2)


def _between(n: Column, low: int, high: int) -> Column:
    return F.when(n < low, 0).when(n <= high, 1).otherwise(2)


def _few(n: Column) -> Column:
    return F.when(n <= 1, 0).when(n <= 5, 1).otherwise(2)


def _groups(match: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(match, pattern), lambda g: g != ""))


def _sound_address(match: Column) -> Column:
    """Dotted numbers up to 255, or hexadecimal groups: eight, or fewer with one gap."""
    hexadecimal = _groups(match, ":")
    gap = (F.length(match) - F.length(F.replace(match, F.lit("::"), F.lit("")))) / 2
    groups = ((hexadecimal == 8) & (gap == 0)) | ((hexadecimal < 8) & (hexadecimal >= 2) & (gap == 1))
    return F.when(F.contains(match, F.lit(".")), _octets(match)).otherwise(groups)


def _features(kind: str, m: Column) -> Column:
    """What the trees see; the same for all ways to write a span."""
    match = m["match"]

    def row(digits: Column, groups: Column, sound: Column) -> Column:
        return F.struct(
            digits.alias("digits"), groups.alias("groups"), F.coalesce(sound, F.lit(False)).cast("int").alias("sound"),
            F.lower(m["before"]).rlike(KEYWORDS[kind]).cast("int").alias("keyword"),
            _around(F.right(m["before"], F.lit(1))).alias("before"), _around(m["after"]).alias("after"),
        )

    if kind == "email":
        labels = F.split(match, r"@|\(at\)|\[at\]|\.|\(dot\)|\[dot\]")
        return row(F.lit(1), _few(F.size(labels)), F.trim(F.get(labels, F.size(labels) - 1)).rlike("^[A-Za-z]{2,}[0-9-]*$"))
    if kind == "ip":
        return row(F.lit(1), _few(_groups(match, "[.:]")), _sound_address(match))
    if kind == "card":
        return let(_digits(match), lambda d: row(_between(F.length(d), 14, 19), _few(_groups(match, "[^0-9]+")), luhn(d)))
    # Without the sign of a foreign number; one group of digits may be anything, so it is only sound behind a keyword.
    digits = F.regexp_replace(_digits(match), "^00", "")
    several = _groups(match, "[^0-9]+")
    sound = (several.between(2, 5) | F.lower(m["before"]).rlike(KEYWORDS[kind])) & ~match.rlike(DATE)
    return row(_between(F.length(digits), 10, 15), _few(several), sound & F.length(digits).between(10, 15))


def blanked(text: Column, kind: str, pattern: str) -> Column:
    """The text with the pattern's valid matches turned into zero characters, as many as they have."""
    pair = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def rebuilt(parts: Column) -> Column:
        blank = F.transform(parts["found"], lambda m: F.when(valid(kind, m), F.repeat(F.lit("\0"), F.length(m))).otherwise(m))
        return let(blank, lambda found: F.array_join(F.transform(parts["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(found, i), F.lit("")))), ""))

    return F.when(text.rlike(NEEDS[kind]), let(pair, rebuilt)).otherwise(text)


def add_candidates(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the proposed spans of all kinds with their features: those of the base rules, then the grouped forms in what
    these leave, then the wide forms in what is left of that. ``label`` is 1 for spans of the base rules, 0 for those that
    no reading makes sound, and null for the rest, which the trees decide."""
    rest, base, grouped = (free_name(docs, n) for n in ("_rest", "_base", "_grouped"))

    def every(patterns: dict[str, str], confirmed: bool = False) -> Column:
        found = [_spans(matches(F.col(rest), patterns[k], NEEDS[k]), n, k, confirmed) for n, k in enumerate(KINDS) if k in patterns]
        return F.concat(F.array().cast(_SPAN_TYPE), *[F.coalesce(f, F.array().cast(_SPAN_TYPE)) for f in found])

    def without(step: DataFrame, patterns: dict[str, str], found: str) -> DataFrame:
        for kind, pattern in patterns.items():
            step = step.withColumn(rest, F.when(F.size(found) > 0, blanked(F.col(rest), kind, pattern)).otherwise(F.col(rest)))
        return step

    step = without(docs.withColumn(rest, text).withColumn(base, every(BASE, True)), BASE, base)
    step = without(step.withColumn(grouped, every(GROUPED)), GROUPED, grouped)
    return step.withColumn(name, F.concat(base, grouped, every(WIDE))).drop(rest, base, grouped)


def _spans(found: Column, number: int, kind: str, base: bool) -> Column:
    found = F.filter(found, lambda m: valid(kind, m["match"])) if base else found

    def row(m: Column) -> Column:
        return let(_features(kind, m), lambda x: F.struct(
            m["start"].alias("start"), F.lit(number).alias("kind"), m["stop"].alias("stop"),
            (F.lit(1) if base else F.when((x["sound"] == 0) | (x["digits"] != 1), 0)).alias("label"), x.alias("x"),
        ))

    return F.transform(found, row)


_SPAN_TYPE = f"array<struct<start:int,kind:int,stop:int,label:int,x:struct<{','.join(f'{f}:int' for f in FEATURES)}>>>"
_PLACE_TYPE = "array<struct<start:int,kind:int,stop:int>>"


def prior(kind: str) -> list[tuple[tuple[int, ...], bool]]:
    """Every combination of features, and whether it speaks for personal data: the right number of digits, a sound
    reading, and no letter or digit next to it."""
    names = list(FEATURES)
    cells = []
    for values in product(*[range(n) for n in FEATURES.values()]):
        x = dict(zip(names, values))
        good = x["digits"] == 1 and x["sound"] == 1 and x["before"] != 1 and x["after"] != 1 and (kind != "phone" or x["groups"] == 1 or x["keyword"] == 1)
        cells.append((values, good))
    return cells


class SpanModel:
    """Trees per kind and the least score that a proposed span needs."""

    def __init__(self, trees: dict[int, Trees], least: dict[int, float]):
        self.trees, self.least = trees, least

    def accepted(self, span: Column) -> Column:
        decision = F.lit(False)
        for kind, trees in self.trees.items():
            decision = F.when(span["kind"] == kind, _tree_sum(trees, span["x"]) >= self.least[kind]).otherwise(decision)
        return decision


def _tree_sum(trees: Trees, x: Column) -> Column:
    """The trees' sum as SQL conditions."""
    def node(t: int, i: int) -> Column:
        inner = trees.feature.shape[1]
        if i >= inner:
            return F.lit(float(trees.leaf[t, i - inner]))
        if np.isinf(trees.cut[t, i]):
            return node(t, 2 * i + 1)
        return F.when(x[list(FEATURES)[int(trees.feature[t, i])]] > float(trees.cut[t, i]), node(t, 2 * i + 2)).otherwise(node(t, 2 * i + 1))

    total = F.lit(float(trees.base))
    for t in range(len(trees.leaf)):
        total = total + node(t, 0)
    return total


def fit_spans(spans: DataFrame, column: str = "spans") -> SpanModel:
    """Trees and thresholds from every labelled candidate of the corpus, by counts per combination of features.

    The prior's combinations count as ``PRIOR`` candidates of either label. A kind's threshold is calibrated on the
    labelled candidates and the prior: at its score and at every higher one, ``PRECISION`` of those scored so are positive.
    """
    names = list(FEATURES)
    cells = (
        spans.select(F.explode(column).alias("s")).filter("s.label is not null").groupBy("s.kind", *[F.col(f"s.x.{f}").alias(f) for f in names])
        .agg(F.count_if(F.col("s.label") == 1).alias("yes"), F.count_if(F.col("s.label") == 0).alias("no")).collect()
    )
    trees, least = {}, {}
    for number, kind in enumerate(KINDS):
        counts = {tuple(r[f] for f in names): (r["yes"], r["no"]) for r in cells if r["kind"] == number}
        expected = prior(kind)
        x = np.array([v for v, _ in expected], float)
        good = np.array([g for _, g in expected])
        seen = np.array([counts.get(v, (0, 0)) for v, _ in expected], float)
        yes, no = seen[:, 0] + np.where(good, PRIOR / good.sum(), 0), seen[:, 1] + np.where(good, 0, PRIOR / (~good).sum())
        model = fit_trees(np.concatenate((x, x)), np.repeat([1.0, 0.0], len(x)), TREES, DEPTH, np.concatenate((yes, no)))
        levels, at = np.unique(np.round(model.raw(x), 9), return_inverse=True)
        share = np.bincount(at, yes)[::-1].cumsum() / np.bincount(at, yes + no)[::-1].cumsum()
        enough = np.cumprod(share >= PRECISION).astype(bool)[::-1]
        trees[number], least[number] = model, float(levels[enough].min()) - 1e-6 if enough.any() else np.inf
    return SpanModel(trees, least)


def _placed(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["kind"].alias("kind"), span["stop"].alias("stop"))


def selected(spans: Column, model: SpanModel) -> Column:
    """All spans of the base rules, and the proposed ones that the trees accept. Proposed spans lie beside the base ones;
    those of different kinds may overlap each other."""
    chosen = F.filter(spans, lambda s: F.coalesce(s["label"] == 1, F.lit(False)) | (s["label"].isNull() & model.accepted(s)))
    return F.when(F.size(spans) == 0, F.array().cast(_PLACE_TYPE)).otherwise(F.array_sort(F.array_distinct(F.transform(chosen, _placed))))


def confirmed(spans: Column) -> Column:
    return F.array_sort(F.transform(F.filter(spans, lambda s: F.coalesce(s["label"] == 1, F.lit(False))), _placed))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base, spans)`` per row: sorted arrays of ``(start, kind, stop)``, ``kind`` an index into ``KINDS``.

    Null and empty texts have none; rows are told apart by nothing but their place, so repeated keys do no harm.
    """
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = cut_lineage(add_candidates(rows, F.col("t"), "spans").drop("t"))
    model = fit_spans(found)
    return found.select(F.col("_k").alias(key), confirmed(F.col("spans")).alias("base"), selected(F.col("spans"), model).alias("spans"))


def _most_before(values: Column, block: int = 256) -> Column:
    """Greatest value before each place (0 before the first), in blocks so that long arrays take no quadratic time."""
    def in_blocks(vs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(vs) / block).cast("int") - 1)
        part = lambda b: F.slice(vs, b * block + 1, block)
        earlier = lambda xs, n: F.coalesce(F.array_max(F.slice(xs, F.lit(1), n)), F.lit(0))
        starts = let(F.transform(numbers, lambda b: F.array_max(part(b))), lambda tops: F.transform(tops, lambda _, b: earlier(tops, b)))
        return let(starts, lambda s: F.flatten(F.transform(numbers, lambda b: let(part(b), lambda p: F.transform(p, lambda _, i: F.greatest(s[b], earlier(p, i)))))))

    return let(values, in_blocks)


def redacted(text: Column, spans: Column, names: Sequence[str] = KINDS) -> Column:
    """The text with every span, overlapping ones as one, replaced by its kind's name in square brackets."""
    labels = F.array(*[F.lit(f"[{n.upper()}]") for n in names])

    def rebuilt(found: Column) -> Column:
        def pieces(upto: Column) -> Column:
            made = F.transform(found, lambda s, i: F.when(s["start"] >= upto[i], F.concat(F.substring(text, upto[i] + 1, s["start"] - upto[i]), labels[s["kind"]])).otherwise(""))
            return F.concat(F.array_join(made, ""), F.substring(text, F.array_max(F.transform(found, lambda s: s["stop"])) + 1, F.length(text)))

        return let(_most_before(F.transform(found, lambda s: s["stop"])), pieces)

    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(let(spans, rebuilt))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced in their text, and ``length`` (if a column) counted anew."""
    spans = free_name(docs, "_spans")
    # Written with their candidates, so that these are searched for once.
    marked = cut_lineage(add_candidates(docs, F.coalesce(F.col(text), F.lit("")), spans))
    out = marked.withColumn(text, redacted(F.col(text), selected(F.col(spans), fit_spans(marked, spans))))
    if length in docs.columns:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
