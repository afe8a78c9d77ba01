"""Personal data: formats that are certain, and what their contexts lead to."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import gathered, materialise
from .common import batch_steps, free_name

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that does not match from its start matches from no later place either.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: Looser shapes of what a context may reveal, with the kinds each can be.
NUMBER = re.compile(r"(?<![\w.+-])[(]?[0-9](?:[ ()./-]{0,2}[0-9])+(?![\w-])")
ADDRESS = re.compile(r"(?<!\S)[^\s@]{1,64}?(?:@|\(at\)|\[at\])[^\s@]{1,255}(?!\S)")
HEXES = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")
NEAR = re.compile(r"[^\W\d_]+|[:=]")
FRAME = 80


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)]
    if not DIGIT.search(text):
        return found
    found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(DIGIT.findall(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def _value(kind: int, text: str) -> str:
    """What makes two mentions the same instance."""
    if kind in (2, 3):
        return "".join(DIGIT.findall(text))
    return text.lower().replace("(at)", "@").replace("[at]", "@")


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[list[int], int, int]]:
    """(kinds, start, end) of loose shapes that overlap no base span."""
    spans = sorted((a, b) for _, a, b in taken)
    ahead = 0
    loose = []
    if "@" in text or "(at)" in text or "[at]" in text:
        loose += [([0], *m.span()) for m in ADDRESS.finditer(text)]
    for m in NUMBER.finditer(text) if DIGIT.search(text) else ():
        n = len(DIGIT.findall(m[0]))
        kinds = [2] * (12 <= n <= 19) + [3] * (7 <= n <= 15)
        if kinds:
            loose.append((kinds, *m.span()))
    loose += [([1], *m.span()) for m in HEXES.finditer(text)] if ":" in text else []
    for kinds, a, b in sorted(loose, key=lambda x: x[1:]):
        while ahead < len(spans) and spans[ahead][1] <= a:
            ahead += 1
        if ahead == len(spans) or spans[ahead][0] >= b:
            yield kinds, a, b


def _patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical contexts: the two words before, and the word on either side."""
    left = NEAR.findall(text[max(0, start - FRAME) : start].lower())
    right = NEAR.findall(text[end : end + FRAME].lower())
    found = []
    if len(left) > 1:
        found.append(f"{left[-2]} {left[-1]} _")
    if left and right:
        found.append(f"{left[-1]} _ {right[0]}")
    return found


_SPAN = "struct<kind int, start int, end int>"
_MENTION = "struct<kinds array<int>, start int, end int, value string, patterns array<string>, seed boolean>"


def mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, base (spans) and all mentions with their contexts; null is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in batch_steps(batch, "text"):
                base, around = [], []
                for t in texts:
                    spans = base_spans(t)
                    base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    seen = [([k], a, b, True) for k, a, b in spans]
                    seen += [(k, a, b, False) for k, a, b in _candidates(t, spans)]
                    around.append(
                        [
                            {
                                "kinds": k,
                                "start": a,
                                "end": b,
                                "value": _value(k[0], t[a:b]),
                                "patterns": _patterns(t, a, b),
                                "seed": s,
                            }
                            for k, a, b, s in seen
                        ]
                    )
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "text_hash": rows.column("text_hash"),
                        "base": pa.array(base, _BASE_TYPE),
                        "mentions": pa.array(around, _MENTION_TYPE),
                    }
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text")
    ).mapInArrow(work, f"doc_id {kind}, text_hash bigint, base array<{_SPAN}>, mentions array<{_MENTION}>")


_BASE_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_MENTION_TYPE = pa.list_(
    pa.struct(
        [
            ("kinds", pa.list_(pa.int32())),
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("value", pa.string()),
            ("patterns", pa.list_(pa.string())),
            ("seed", pa.bool_()),
        ]
    )
)


def bootstrap(seen: DataFrame, rounds: int, support: int, sure: float) -> DataFrame:
    """(kind, value, trust) of instances that are no seeds but whose patterns are trusted.

    ``seen`` has kind, value, pattern, seed. A pattern is trusted for a kind by the share of its
    different instances that are trusted to be of that kind, once at least ``support`` of them are;
    an instance by the chance that not all of its trusted patterns err. Seeds have trust 1.
    """
    pairs = materialise(seen.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")))
    rows = pairs.count()
    matched = pairs.groupBy("pattern").agg(F.count_distinct("value").alias("matched"))
    trust = pairs.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    for _ in range(rounds):
        score = (
            pairs.select("pattern", "kind", "value")
            .join(trust.filter(F.col("trust") > 0), ["kind", "value"])
            .groupBy("pattern", "kind")
            .agg(F.sum("trust").alias("trusted"))
            .filter(F.col("trusted") >= support)
            .join(matched, "pattern")
            .select("pattern", "kind", (F.col("trusted") / (F.col("matched") + 1)).alias("score"))
            .filter(F.col("score") >= sure / 2)
        )
        trust = (
            pairs.join(score, ["pattern", "kind"], "left")
            .groupBy("kind", "value")
            .agg(
                F.max("seed").alias("seed"),
                (1 - F.exp(F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.99)))))).alias("chance"),
            )
            .select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(F.col("chance")).alias("trust"))
        )
        trust = materialise(gathered(trust, rows))
    return trust.filter(F.col("trust") >= sure)


def _of_kind(kind: int):
    return lambda span: span["kind"] == kind


def _joined(spans) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def find_pii(
    docs: DataFrame, rounds: int = 3, support: int = 5, sure: float = 0.6, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, text_hash, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans,
    n_more (spans that the contexts added).

    Base spans are certain by their format. They seed a graph of instances and the lexical patterns
    around them; ``rounds`` rounds carry trust from instances to patterns and back, and loosely
    shaped mentions whose instance ends with a trust of at least ``sure`` are added, never in place of
    or over a base span. A mention that could be of several kinds takes the most trusted. Null
    text is empty, a null id passes through, and of repeated ids each text has its own spans.
    """
    found = materialise(mentions(docs, doc_id, text))
    each = found.select("doc_id", "text_hash", F.explode("mentions").alias("m"))
    seen = each.select(
        F.explode("m.kinds").alias("kind"), F.col("m.value").alias("value"), F.col("m.seed").alias("seed"), F.col("m.patterns").alias("p")
    ).select("kind", "value", "seed", F.explode_outer("p").alias("pattern"))
    trusted = bootstrap(seen, rounds, support, sure)
    loose = each.filter(~F.col("m.seed")).select(
        "doc_id", "text_hash", "m.start", "m.end", "m.value", F.explode("m.kinds").alias("kind")
    )
    best = F.max(F.struct("trust", -F.col("kind"))).alias("best")
    more = (
        loose.join(trusted, ["kind", "value"])
        .groupBy("doc_id", "text_hash", "start", "end")
        .agg(best)
        .select("doc_id", "text_hash", F.struct((-F.col("best.col2")).cast("int").alias("kind"), "start", "end").alias("span"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list("span").alias("more"))  # the mentions of one text
    )
    a, b = found.drop("mentions").alias("a"), more.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    none = F.array().cast(f"array<{_SPAN}>")
    counts = [
        F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)
    ]
    return (
        a.join(b, same, "left")
        .select("a.doc_id", "a.text_hash", "a.base", F.coalesce("b.more", none).alias("more"))
        .select(
            "doc_id",
            "text_hash",
            *counts,
            F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
            _joined(F.array_sort(F.concat("base", "more"))).alias("spans"),
            F.size("more").cast("long").alias("n_more"),
        )
    )


def redacted(text: str, spans: str) -> str:
    """``text`` with the given spans replaced by their kinds, of overlapping ones the earliest, longest."""
    marks = [(int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    parts, done = [], 0
    for a, b, kind in sorted(marks):
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
            done = -b
    return "".join(parts) + text[done:]


def redact_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All rows and columns, with personal data in the text replaced by ``[EMAIL]`` and the like,
    and n_chars, if there is one, set to the new length. A null text stays null."""
    spans = find_pii(docs, doc_id=doc_id, text=text, **how).filter("spans <> ''")
    own, hashed, marked = (free_name(docs, name) for name in ("_own", "_hash", "_spans"))
    spans = spans.select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed), F.col("spans").alias(marked)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(hashed))
    joined = docs.join(spans, same, "left").drop(own, hashed)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(marked).to_pylist()
            new = [redacted(t, s) if s else t for t, s in zip(batch.column(text).to_pylist(), marks, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {c: pa.array(new, pa.string()) if c == text else batch.column(c) for c in names}
            )

    result = joined.mapInArrow(work, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        result = result.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(kind))
    return result


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    """What base_sha256 is for the given spans."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
