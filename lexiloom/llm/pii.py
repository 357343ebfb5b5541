"""Personal data: fixed patterns, and bootstrapped contextual extraction on top.

The four fixed kinds (email, ip, card, phone) give the base spans.  They are also
the seeds of a bootstrap over the corpus: every seed and every other token that
looks like an identifier is an *instance*, and the words around it (two to the
left, one to the left, one to the right, one on each side) are *patterns*.  Spark
scores the bipartite graph in rounds: a pattern's confidence in a kind is the
confidence-weighted share of its distinct instances, damped; an instance's is the
best of its confident patterns.  Patterns that end above CONFIDENCE with SUPPORT
distinct seeds or more add the identifiers of a fitting shape that they surround.
The graph stays in tables of the shared folder; nothing of it reaches the driver.

Null texts count as empty; repeated rows get equal spans; rows without doc_id are
searched like others; very long texts are searched whole, very long identifiers and
words known by their hash; an empty table gives an empty result; other columns are not
read.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, staged, table, unused

KINDS = ("email", "ip", "card", "phone")
#: Rounds of the bootstrap, least confidence and least number of distinct seeds of a pattern, damping of small patterns.
ROUNDS, CONFIDENCE, SUPPORT, DAMPING = 3, 0.8, 5, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from any other, so a run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an @ has one run of local characters before it, so runs are looked at from the @ backwards."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """In the order of KINDS, then of their starts."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# --- instances and patterns ------------------------------------------------------------------------
_TOKEN = re.compile(r"\S+")
_TRIM = ".,;:!?\"'()[]{}<>="


def shapes(token: str) -> list[str]:
    """Kinds that a token without a base match could still be: an obscured address, a number written otherwise."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    out = []
    if letters >= 3 and (re.search(r"[\[({]at[\])}]|@", token, re.I)):
        out.append("email")
    if 4 <= digits <= 12 and not letters and len(re.findall(r"[.:]", token)) == 3:
        out.append("ip")
    if 12 <= digits <= 19 and not letters:
        out.append("card")
    if 7 <= digits <= 15 and not letters:
        out.append("phone")
    return out


def _fold(word: str) -> str:
    return instance(re.sub(r"[0-9]", "0", word.lower().strip(_TRIM)))


def patterns(left: list[str], right: list[str]) -> list[str]:
    """left: up to two words before, right: up to one after."""
    a = [_fold(w) for w in left]
    b = _fold(right[0]) if right else ""
    out = []
    if len(a) == 2 and a[0] and a[1]:
        out.append(f"{a[0]} {a[1]} _")
    if a and a[-1]:
        out.append(f"{a[-1]} _")
        if b:
            out.append(f"{a[-1]} _ {b}")
    if b:
        out.append(f"_ {b}")
    return out


INSTANCE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("base", pa.list_(pa.string())), ("seeds", pa.list_(INSTANCE)), ("others", pa.list_(INSTANCE))])
_INSTANCES = "array<struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>>"
FOUND_DDL = f"doc_id long, text_key string, base array<string>, seeds {_INSTANCES}, others {_INSTANCES}"


def observe(text: str) -> tuple[list[str], list[dict], list[dict]]:
    """Base spans, and seeds and other identifier-like tokens with the patterns around them."""
    base = base_spans(text)
    if not base and not _DIGIT.search(text) and "@" not in text and not re.search(r"[\[({]at[\])}]", text, re.I):
        return [], [], []
    spans = sorted((s, e, k) for k, s, e in base)

    words = [m.span() for m in _TOKEN.finditer(text)]
    starts = [s for s, _ in words]

    def around(start: int, end: int) -> list[str]:
        """Patterns of the two words before a place, however far they are, and of the one behind it; a word that the place cuts counts with its part."""
        i = bisect_left(starts, start)
        left = [text[s : min(e, start)] for s, e in words[max(0, i - 2) : i]]
        while end < len(text) and text[end] in _TRIM:
            end += 1
        j = bisect_right(starts, end) - 1
        if j < 0 or words[j][1] <= end:
            j += 1
        return patterns(left, [text[max(end, words[j][0]) : words[j][1]]] if j < len(words) else [])

    seeds = [{"kind": k, "start": s, "end": e, "instance": instance(text[s:e]), "patterns": around(s, e)} for s, e, k in spans]
    others, i = [], 0
    for m in re.finditer(r"\S*[0-9@\[({]\S*", text):
        token = m.group()
        start = m.start() + len(token) - len(token.lstrip(_TRIM[:-1].replace("[", "").replace("(", "").replace("{", "")))
        end = start + len(token[start - m.start() :].rstrip(_TRIM.replace("]", "").replace(")", "").replace("}", "")))
        kinds = shapes(text[start:end])
        if not kinds:
            continue
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        if any(s < end and e > start for s, e, _ in spans[max(0, i - 1) : i + 3]):
            continue
        near = around(start, end)
        others += [{"kind": k, "start": start, "end": end, "instance": instance(text[start:end]), "patterns": near} for k in kinds]
    return [f"{k}:{s}:{e}" for k, s, e in base], seeds, others


def instance(found: str) -> str:
    """How an identifier or a word is known: lower case, a very long one by its hash."""
    low = found.lower()
    return low if len(low) <= 200 else hashlib.sha256(low.encode("utf-8", "surrogatepass")).hexdigest()


def observations(docs: DataFrame) -> DataFrame:
    """One row per document: its base spans and what the bootstrap needs of it."""
    inner = docs.select(F.col("doc_id").cast("long").alias("k"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, texts = (c.to_pylist() for c in batch.columns)
            yield record_batch(FOUND, [(k, h, *observe(t)) for k, h, t in zip(keys, hashes, texts, strict=True)])

    return inner.mapInArrow(run, FOUND_DDL)


def confident_patterns(found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """pattern, kind, p: the patterns that the rounds leave above `confidence`. found: a stable table."""

    def edges(column: str, seed: bool) -> DataFrame:
        one = found.select(F.explode(column).alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.instance", "x.kind")
        return one.distinct().withColumn("seed", F.lit(seed))

    graph = staged(edges("seeds", True).union(edges("others", False)), "pii-graph")
    total = graph.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    seeded = graph.where("seed").groupBy("pattern", "kind").agg(F.count("*").alias("n_seeds")).where(F.col("n_seeds") >= support)
    # Only patterns with enough seeds can ever be confident; the rest of the graph is left out of the rounds.
    core = staged(graph.join(seeded.select("pattern").distinct().hint("merge"), "pattern", "left_semi").join(total.hint("merge"), "pattern"), "pii-core")
    known = core.where("seed").select("instance", "kind", F.lit(1.0).alias("c")).distinct()
    best = None
    for _ in range(rounds):
        mass = core.join(known.hint("merge"), ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("c").alias("s"), F.first("n").alias("n"))
        scored = mass.select("pattern", "kind", (F.col("s") / (F.col("n") + F.lit(DAMPING))).alias("p")).where(F.col("p") >= confidence)
        best = staged(scored.join(seeded.select("pattern", "kind").hint("merge"), ["pattern", "kind"]), "pii-patterns")
        gained = core.where("not seed").join(best.hint("merge"), ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("p").alias("c"))
        known = core.where("seed").select("instance", "kind", F.lit(1.0).alias("c")).distinct().union(gained).groupBy("instance", "kind").agg(F.max("c").alias("c"))
    return best


def added_spans(found: DataFrame, best: DataFrame) -> DataFrame:
    """doc_id, text_key, added (kind:start:end): per place the kind of its most confident pattern."""
    places = found.select("doc_id", "text_key", F.explode("others").alias("x")).select("doc_id", "text_key", "x.*").withColumn("pattern", F.explode("patterns"))
    place = ["doc_id", "text_key", "start", "end"]
    hit = places.join(best.hint("merge"), ["pattern", "kind"]).groupBy(*place).agg(F.max(F.struct("p", "kind")).alias("m"))
    return hit.groupBy("doc_id", "text_key").agg(F.collect_set(F.concat_ws(":", "m.kind", "start", "end")).alias("added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, added: arrays of kind:start:end."""
    found = staged(observations(docs), "pii")
    added = added_spans(found, confident_patterns(found)).withColumnsRenamed({"doc_id": "_d", "text_key": "_h"})
    rows = found.select("doc_id", "text_key", "base")
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_h")), "left")
    return joined.select("doc_id", "text_key", "base", F.coalesce("added", F.array().cast("array<string>")).alias("added"))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans become <EMAIL> and the like; where spans overlap, the one that begins first (the longer of equals) stands for all."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < done:
            if end > done:
                done = end
            continue
        out += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join(out) + text[done:]


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` masked; all columns and all other characters stay. Null texts stay null."""
    id_name, hash_name, added_name, key_name = unused(docs.columns, "_d", "_h", "_added", "_key")
    found = staged(observations(docs), "pii")
    added = staged(added_spans(found, confident_patterns(found)), "pii-added").withColumnsRenamed({"doc_id": id_name, "text_key": hash_name, "added": added_name})
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    # The side of added spans is broadcast only where its measured size is under Spark's limit.
    joined = docs.withColumn(key_name, key).join(added, F.col("doc_id").cast("long").eqNullSafe(F.col(id_name)) & (F.col(key_name) == F.col(hash_name)), "left").select(*docs.columns, added_name)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, more in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                spans = base_spans(t or "")
                for x in more or []:
                    kind, start, end = x.split(":")
                    spans.append((kind, int(start), int(end)))
                texts.append(mask(t, spans) if spans else t)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.record_batch(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    rank = F.array(*[F.lit(k) for k in KINDS])

    def by_kind(spans):
        """Base and added spans in the order of KINDS, then of their starts."""
        keyed = F.transform(spans, lambda s: F.struct(F.array_position(rank, F.split(s, ":")[0]).alias("k"), F.split(s, ":")[1].cast("long").alias("a"), F.split(s, ":")[2].cast("long").alias("b"), s.alias("s")))
        return F.transform(F.array_sort(keyed), lambda x: x["s"])

    return found.select("doc_id", *counts, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(by_kind(F.array_union("base", "added")), ",").alias("spans"), F.size("added").cast("long").alias("n_added"))
