"""Personal data: fixed patterns, then contexts learnt from what they find.

Base spans (email, ip, card, phone) are the seeds. Every identifier in the text,
a run of characters with a digit that is long enough, has contexts: the word
before it, the two words before it, and the words on both sides. Contexts and
identifiers form a graph with counted edges. Spark scores it in turns: a context
is as reliable as the identifiers it surrounds, an identifier as its contexts;
seeds keep the value 1. Contexts that stay reliable and have met enough
different seeds then mark unseen identifiers as spans of kind ``id``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyframe.llm import units
from tallyframe.session import stored

ROUNDS, LEAST, SEEDS, SHORTEST = 3, 0.75, 3, 6
KINDS = ("email", "ip", "card", "phone", "id")
# An email is found from its "@": the longest run of local characters before it,
# and a host after it. The other kinds begin where no match could have begun before.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[^\s,;:()\[\]<>\"']+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
LONGEST_WORD = 80  # a longer word is no context; none is ever cut
_FOUND = "spans array<struct<kind:int,s:int,e:int>>, met array<struct<s:int,e:int,item:string,seed:boolean,contexts:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _byte(digits: str) -> bool:
    """Whether the number is at most 255; int() refuses very long ones."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping; each character is looked at a few times at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), ordered by start, then kind. Per kind leftmost, not
    overlapping; a match that fails its test is dropped and not tried again."""
    out = []
    out += [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


class Words:
    """The words of a text by place. Up to a place, or from it, a word counts as far
    as it reaches; one of more than ``LONGEST_WORD`` characters is no context."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def _shown(self, start: int, end: int) -> str | None:
        return self.text[start:end].lower() if end - start <= LONGEST_WORD else None

    def contexts(self, start: int, end: int) -> list[str]:
        i = bisect_left(self.starts, start) - 1  # the last word that begins before
        one = self._shown(self.starts[i], min(self.ends[i], start)) if i >= 0 else None
        if one is None:
            return []
        found = [f"1 {one}"]
        two = self._shown(self.starts[i - 1], self.ends[i - 1]) if i >= 1 else None
        if two is not None:
            found.append(f"2 {two} {one}")
        k = bisect_right(self.ends, end)  # the first word that ends after
        after = self._shown(max(self.starts[k], end), self.ends[k]) if k < len(self.ends) else None
        if after is not None:
            found.append(f"3 {one} | {after}")
        return found


def identifiers(text: str, spans: list[tuple[int, int, int]], shortest: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, seed): the base spans, and other identifiers outside them."""
    yield from ((s, e, True) for _, s, e in spans)
    at = 0
    for m in _RUN.finditer(text):
        if not _DIGIT.search(m[0]):
            continue
        a, b = m.start(), m.end()
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        if b - a >= shortest and not any(s < b and a < e for _, s, e in spans[at : at + 8]):
            yield a, b, False


def _extracted(docs: DataFrame, shortest: int) -> DataFrame:
    keep = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            for part in units.slices(batch):
                spans, met = [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text) if _HINT.search(text) else []
                    spans.append([{"kind": k, "s": s, "e": e} for k, s, e in base])
                    near = list(identifiers(text, base, shortest)) if _HINT.search(text) else []
                    words = Words(text) if near else None
                    met.append([
                        {"s": s, "e": e, "item": text[s:e].lower(), "seed": seed, "contexts": words.contexts(s, e)} for s, e, seed in near
                    ])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in keep), pa.array(spans, _SPANS), pa.array(met, _MET)],
                    [*(f.name for f in keep), "spans", "met"])

    return docs.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in keep), *StructType.fromDDL(_FOUND)]))


_HINT = re.compile(r"[0-9@]")
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
_MET = pa.list_(pa.struct([
    ("s", pa.int32()), ("e", pa.int32()), ("item", pa.string()), ("seed", pa.bool_()), ("contexts", pa.list_(pa.string())),
]))


def reliable_contexts(met: DataFrame, rounds: int, least: float, seeds: int) -> DataFrame:
    """(context) from rows (item, seed, context): those whose reliability is at
    least ``least`` after ``rounds`` rounds and that have ``seeds`` different seeds.

    The graph holds each (context, item) once with its count, so a frequent
    context or item is summed before it is shuffled.
    """
    edges = stored(met.groupBy("context", "item").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "graph")
    trust = edges.groupBy("item").agg(F.max("seed").cast("double").alias("trust"))
    for _ in range(rounds):
        context = edges.join(trust, "item").groupBy("context").agg(
            (F.sum(F.col("n") * F.col("trust")) / (F.sum("n") + 1.0)).alias("reliable")
        )
        trust = stored(edges.join(context, "context").groupBy("item").agg(
            F.when(F.max("seed"), F.lit(1.0)).otherwise(F.sum(F.col("n") * F.col("reliable")) / (F.sum("n") + 1.0)).alias("trust")
        ), "trust")
    return edges.join(trust, "item").groupBy("context").agg(
        (F.sum(F.col("n") * F.col("trust")) / (F.sum("n") + 1.0)).alias("reliable"), F.sum(F.col("seed").cast("int")).alias("seeds")
    ).where((F.col("reliable") >= least) & (F.col("seeds") >= seeds)).select("context")


def _added(met: DataFrame, row: str, rounds: int, least: float, seeds: int) -> DataFrame:
    """(row, added): the spans of kind ``id`` that reliable contexts add, from the
    stored identifiers (row, met). Equal rows may share a value of ``row``."""
    each = met.select(row, F.explode("met").alias("m")).select(
        row, "m.s", "m.e", "m.item", "m.seed", F.explode("m.contexts").alias("context")
    )
    good = stored(reliable_contexts(each, rounds, least, seeds), "contexts")
    kept = each.where("not seed").join(good, "context", "left_semi").select(row, "s", "e").distinct()
    return kept.groupBy(row).agg(F.collect_list(F.struct(F.lit(KINDS.index("id")).alias("kind"), "s", "e")).alias("added"))


def personal_spans(docs: DataFrame, rounds: int = ROUNDS, least: float = LEAST, seeds: int = SEEDS, shortest: int = SHORTEST) -> DataFrame:
    """The columns of ``docs`` but text, and ``found``: (kind, s, e) in code
    points, ends exclusive, ordered by start, then kind; base spans always.
    ``docs`` has no column spans, met, found, added or row_number_: callers put
    columns of any name into one struct.

    A null or empty text has none. Repeated rows are judged alike, one by one.
    An empty table gives an empty result.
    """
    met = _extracted(docs.withColumn("row_number_", F.monotonically_increasing_id()), shortest)
    met = stored(met, "identifiers")
    added = _added(met, "row_number_", rounds, least, seeds)
    both = met.drop("met").join(added, "row_number_", "left").withColumn(
        "found", F.concat("spans", F.coalesce("added", F.array().cast("array<struct<kind:int,s:int,e:int>>")))
    )
    ordered = F.sort_array(F.transform("found", lambda f: F.struct(f["s"].alias("s"), f["kind"].alias("kind"), f["e"].alias("e"))))
    return both.withColumn("found", ordered).drop("row_number_", "added")


def _listed(spans) -> F.Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(
        ":", F.get(names, f["kind"]), f["s"].cast("string"), f["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row
    of ``docs`` (doc_id, text); see ``personal_spans`` for the cases."""
    found = personal_spans(docs.select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda f: f["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(k) for k in KINDS[:4]),
        F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by the name of its kind in
    brackets; spans that touch or overlap become one, named by the first. Where
    there is a column n_chars it is the new length of texts that changed."""
    names = list(KINDS)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    row = F.struct(*(F.col(f"`{f.name}`") for f in rest)).alias("row")
    # The key of a row is the same on every read, so that only identifiers are stored
    # and the texts are joined with what was added to them. Equal rows share it.
    keyed = docs.select(row, "text", F.unhex(F.md5(F.to_json(F.struct("*")))).alias("key"))
    met = stored(_extracted(keyed.select("key", "text"), SHORTEST).select("key", "met").where(F.size("met") > 0), "identifiers")
    found = keyed.join(_added(met, "key", ROUNDS, LEAST, SEEDS), "key", "left").select("row", "text", "added")

    def run(batches):
        for batch in batches:
            texts, lists = batch.column("text").to_pylist(), batch.column("added").to_pylist()
            out = []
            for text, added in zip(texts, lists, strict=True):
                spans = base_spans(text) if text and _HINT.search(text) else []
                spans = sorted([(s, k, e) for k, s, e in spans] + [(f["s"], f["kind"], f["e"]) for f in added or ()])
                if spans:
                    parts, at = [], 0
                    for s, kind, e in spans:
                        if s >= at:
                            parts += [text[at:s], f"[{names[kind]}]"]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    out = found.mapInArrow(run, StructType([StructField("row", found.schema["row"].dataType), StructField("text", StringType())]))

    def column(name: str):
        if name == "text":
            return F.col("text")
        own = F.col("row").getField(name)
        if name == "n_chars":
            own = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), own)
        return own.alias(name)

    return out.select(*(column(c) for c in docs.columns))
