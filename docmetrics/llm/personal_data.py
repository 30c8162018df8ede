"""Personal data by candidate spans and gradient-boosted trees, in native columns only.

Generators of high recall propose spans that may overlap: every match of the base patterns,
whether it passes its check or not, and looser forms (spelled-out @ and dots, numbers in groups
without a plus sign, addresses in colon form). Each candidate gets small integer features of
its format (digits, groups, separators, letters) and context (cue words before it, letters or
digits that touch it). Candidates that pass the base checks are positive examples, those that
touch no such span are negative ones. Since features are small integers, the counts of both
per feature vector are exact sufficient statistics: one aggregate over all documents, whose
size is bounded by the number of vectors, not by the data. Shallow trees are boosted on these
counts and compiled to a column expression. The threshold is the lowest score above which the
share of positives reaches a given precision. Base spans always stay; others are added.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")

# Patterns start only where an earlier start in the same run would not have matched (or where
# the last match ended), and repeat possessively: the JVM neither retries nor recurses.
_RUN = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_RUN})){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",  # shorter runs never pass
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[\[(](?:at|AT)[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?:(?<![0-9+(])\([0-9]{2,4}\)\x20?|(?<![0-9.+(-])[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
GUARDS = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][\x20./_-]{0,2}[0-9]", "phone": r"\+[0-9][\x20().0-9-]|[0-9][\x20.()-]{0,2}[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CUES = r"(?i)(?:mail|contact|write|tel|phone|call|mobile|fax|host|server|addr|login|card|visa|pay|account)[a-z]*[\x20:=(\[]{0,4}$"

#: Names of the features, all small integers, and the values that each may take.
FEATURES = {"kind": 4, "digits": 8, "groups": 7, "letters": 2, "parens": 2, "dashes": 2, "dots": 2, "at": 2, "cue": 2, "touched": 2}

_SPAN = "struct<kind:int,start:int,end:int,text:string,base:boolean>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes(kind: str, text: Column) -> Column:
    """The base check of a match."""
    d = _digits(text)
    return {
        "email": F.lit(True),
        "ip": text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.when(F.length(d).between(16, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False)),
        "phone": F.length(d).between(8, 15),
    }[kind]


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and the text around them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _placed(matches: Column, around: Column, kind: str, base: bool) -> Column:
    """Matches as spans in code points."""
    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["around"])
        end = start + F.length(x["match"])
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("text"),
                        (passes(kind, x["match"]) if base else F.lit(False)).alias("base"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.arrays_zip(matches.alias("match"), F.slice(around, 1, F.size(matches)).alias("around"))
    # Spans are appended to short lists, and those to one list: appending copies a list.
    none = F.array().cast(f"array<{_SPAN}>")
    parts = F.transform(F.sequence(F.lit(0), (F.size(matches) / 256).cast("int")), lambda k: F.slice(pairs, k * 256 + 1, F.lit(256)))

    def add_part(acc: Column, part: Column) -> Column:
        start = F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("out"))
        return F.concat(acc, F.array(F.aggregate(part, start, add)))

    first = F.array(F.struct(F.lit(0).alias("at"), none.alias("out")))
    return F.aggregate(parts, first, add_part, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_candidates(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns as c0, c1, ..., text (null: empty) and cands, the candidate spans with features."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    guards, found, spans = {}, {}, {}
    for kind in KINDS:
        guards[f"has_{kind}"] = text.rlike(GUARDS[kind])
    for kind in KINDS:
        for name, pattern in (("base", PATTERNS[kind]), ("loose", LOOSE[kind])):
            m, g = _found(text, pattern)
            none = F.array().cast("array<string>")
            found[f"m_{name}_{kind}"] = F.when(F.col(f"has_{kind}"), m).otherwise(none)
            found[f"g_{name}_{kind}"] = F.when(F.col(f"has_{kind}"), g).otherwise(none)
            spans[f"s_{name}_{kind}"] = _placed(F.col(f"m_{name}_{kind}"), F.col(f"g_{name}_{kind}"), kind, name == "base")
    rows = rows.withColumns(guards).withColumns(found).withColumns(spans)
    rows = rows.withColumn("sure", F.concat(*[F.filter(F.col(f"s_base_{k}"), lambda c: c["base"]) for k in KINDS]))
    every = F.concat(*[F.col(f"s_{n}_{k}") for n in ("base", "loose") for k in KINDS])
    # A span that both generators propose is one candidate; what touches a sure span is none.
    rows = rows.withColumn("some", F.concat(F.col("sure"), F.array_distinct(F.filter(
        every, lambda c: ~c["base"] & (F.length(_digits(c["text"])) + F.when(c["kind"] == 0, 9).otherwise(0) >= 7)
        & ~F.exists(F.col("sure"), lambda s: _overlap(s, c))))))

    def featured(c: Column) -> Column:
        t, n = c["text"], F.length(_digits(c["text"]))
        bucket = F.when(n < 4, 0).when(n < 8, 1).when(n < 10, 2).when(n < 11, 3).when(n < 13, 4).when(n < 16, 5).when(n < 20, 6).otherwise(7)
        before = F.substr(text, F.greatest(c["start"] - 19, F.lit(1)), F.least(c["start"], F.lit(20)))
        flag = {"letters": t.rlike("[A-Za-z]"), "parens": t.rlike("[()]"), "dashes": t.contains("-"), "dots": t.contains("."), "at": t.contains("@"),
                "cue": before.rlike(CUES), "touched": before.rlike("[A-Za-z0-9]$") | F.substr(text, c["end"] + 1, F.lit(1)).rlike("[A-Za-z0-9]")}
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"),
                        bucket.alias("digits"), F.least(F.size(F.split(t, "[^0-9A-Za-z]+")), F.lit(6)).alias("groups"),
                        *[F.coalesce(v, F.lit(False)).cast("int").alias(k) for k, v in flag.items()])

    return rows.select(*[f"c{i}" for i in range(len(columns))], "text", F.transform("some", featured).alias("cands"))


class Trees(NamedTuple):
    trees: list
    prior: float
    threshold: float


def boosted(counts: list[tuple[dict[str, int], int, int]], rounds: int = 30, rate: float = 0.3, precision: float = 0.98) -> Trees:
    """Trees of depth two on (features, positives, negatives), by Newton steps of the log loss."""
    x = {f: np.array([c[0][f] for c in counts], int) for f in FEATURES}
    pos, neg = (np.array([c[i] for c in counts], float) for i in (1, 2))
    prior = math.log((pos.sum() + 1) / (neg.sum() + 1))
    total = np.full(len(counts), prior)
    trees: list = []

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        """A split is (feature, cut, left, right), a leaf its step; g and h: slope and curvature."""
        best = None
        for f, size in FEATURES.items() if depth else ():
            gs, hs = (np.cumsum(np.bincount(x[f][at], v[at], minlength=size)) for v in (g, h))
            n = np.cumsum(np.bincount(x[f][at], minlength=size))
            for cut in range(size - 1):
                if 0 < n[cut] < n[-1]:
                    gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, cut
        if best is None:
            return rate * float(g[at].sum() / (h[at].sum() + 1))
        left = x[best[1]][at] <= best[2]
        return best[1], best[2], grow(at[left], g, h, depth - 1), grow(at[~left], g, h, depth - 1)

    for _ in range(rounds if pos.sum() and neg.sum() else 0):
        m = 1 / (1 + np.exp(-total))
        trees.append(grow(np.arange(len(counts)), pos - m * (pos + neg), m * (1 - m) * (pos + neg), 2))
        total += np.array([_value(trees[-1], c[0]) for c in counts])
    # The lowest score from which on the share of positives is high enough.
    threshold, p, n = float("inf"), 0.0, 0.0
    for i in np.argsort(-total, kind="stable"):
        p, n = p + pos[i], n + neg[i]
        if p >= precision * (p + n) and total[i] > 0:
            threshold = float(total[i])
    return Trees(trees, prior, threshold)


def _value(tree, features: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def _column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, left, right = tree
    return F.when(c[f] <= cut, _column(left, c)).otherwise(_column(right, c))


def score(model: Trees, c: Column) -> Column:
    total = F.lit(model.prior)
    for t in model.trees:
        total = total + _column(t, c)
    return total


def fit(rows: DataFrame) -> Trees:
    """Boost trees on the counts of all candidates. rows: of with_candidates()."""
    names = list(FEATURES)
    got = rows.where(F.size("cands") > 0).select(F.explode("cands").alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in names]).agg(
        F.count_if("c.base").alias("pos"), F.count_if(~F.col("c.base")).alias("neg")).orderBy(*names).collect()
    return boosted([({f: r[f] for f in names}, r["pos"], r["neg"]) for r in got])


def with_spans(rows: DataFrame, model: Trees) -> DataFrame:
    """rows of with_candidates() with spans: base ones, and those that the trees add, by kind and start."""
    keep = F.filter("cands", lambda c: c["base"])
    if math.isfinite(model.threshold):
        rows = rows.withColumn("more", F.filter(F.transform(
            F.filter("cands", lambda c: ~c["base"]), lambda c: F.struct(c.alias("c"), F.round(score(model, c), 9).alias("s"))),
            lambda x: x["s"] >= model.threshold - 1e-6))
        # Of added spans that overlap, the one with the higher score stays, then the first.
        alone = F.filter("more", lambda x: ~F.exists(F.col("more"), lambda o: _overlap(o["c"], x["c"]) & (
            (o["s"] > x["s"]) | ((o["s"] == x["s"]) & (
                F.struct(o["c"]["start"], o["c"]["end"], o["c"]["kind"]) < F.struct(x["c"]["start"], x["c"]["end"], x["c"]["kind"]))))))
        keep = F.concat(keep, F.transform(alone, lambda x: x["c"]))
    slim = F.transform(keep, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return rows.withColumn("spans", F.array_sort(slim)).drop("cands", "more")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by the name of its kind; overlapping spans become the first."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def add(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.element_at(marks, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(new, piece).otherwise(F.lit(""))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(ordered, start, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, n_email, n_ip, n_card, n_phone, base_sha256 and spans (as text) of rows of with_spans()."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == KINDS.index(kind)))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                       _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of docs with all personal data in text replaced; n_chars, if named, follows.

    docs needs text; text must be among the columns. The trees are fitted on these documents. A null text stays
    null, texts without a span stay as they are. Rows are independent: null and repeated ids come
    back as they are, repeated rows are redacted alike. Long texts are read whole. Empty table:
    no rows; without positive examples only base spans are replaced.
    """
    rows = with_candidates(docs, columns)
    rows = with_spans(rows, fit(rows))
    was_null = F.col(f"c{columns.index('text')}").isNull()
    rows = rows.withColumn("new_text", F.when(~was_null, redacted(F.col("text"), F.col("spans"))))

    def column(i: int, name: str) -> Column:
        if name == "n_chars":
            return F.when(was_null | (F.size("spans") == 0), F.col(f"c{i}")).otherwise(F.length("new_text").cast("long"))
        return F.col("new_text") if name == "text" else F.col(f"c{i}")

    return rows.select(*[column(i, c).alias(c) for i, c in enumerate(columns)])


def op10_personal_data(spark, sf_dir):
    """Personal data in all documents."""
    rows = stored(with_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).drop("text"), "candidates")
    return digest(with_spans(rows, fit(rows)), ["doc_id"])
