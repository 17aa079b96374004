"""URL filter by a sorted digest array.

An index holds the 64-bit xxhash keys of all listed strings in ascending
order, and the strings themselves. Tasks memory-map it, look up a batch of
probe keys by vectorised binary search, and compare the stored string of each
hit, so that equal digests of different strings do no harm. Listed are rules
(host and path begin) and terms (words of a host).

Lists are columns or tables: `Filter` judges a column by lists given on the
driver; `judge_by_tables` takes the lists as tables, whose size it looks at
first. Small ones make one index for all executors; larger ones stay where
they are, and the probe strings of the distinct URLs are joined with them.

A rule fits its host and all subdomains if the path starts with the rule's (a
rule without a path fits all paths);
the longest that fits wins (of equally long ones the first by string; of
verdicts that one rule is given, `block`). URLs without a fitting rule are
blocked for a listed term and else allowed; null URLs and such without `://`
have an empty host and path. Each row is judged by itself, repeated rows alike;
an empty table gives no rows, empty lists allow all; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, as_bytes, table

#: Up to this size an index goes to all executors; larger lists are joined.
MOST_INDEX_BYTES = 1 << 28
#: Fixed values of the contract: verdict and rule.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words of hosts that are blocked where no rule fits.
TERMS = ("casino", "escort", "pills", "porn", "viagra", "warez", "xxx")
_TERM = b"\0term:"
_WORDS = re.compile(rb"[^.\-_:@]+")


def serialise(keys: Iterable[bytes]) -> bytes:
    """The index: count, sorted digests, string ends, strings (in the order of the digests)."""
    listed = sorted({(xxhash.xxh64_intdigest(k), k) for k in keys})
    digests = np.array([d for d, _ in listed], "<u8")
    ends = np.cumsum([len(k) for _, k in listed], dtype="<u8")
    return np.array([len(listed)], "<u8").tobytes() + digests.tobytes() + ends.tobytes() + b"".join(k for _, k in listed)


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view("<u8")[0])
        self.digests = whole[8 : 8 + 8 * n].view("<u8")
        self.ends = whole[8 + 8 * n : 8 + 16 * n].view("<u8")
        self.text = whole[8 + 16 * n :]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """For each probe whether it is listed."""
        if not probes or not len(self.digests):
            return np.zeros(len(probes), bool)
        keys = np.array([xxhash.xxh64_intdigest(p) for p in probes], "<u8")
        at = np.searchsorted(self.digests, keys)
        out = np.zeros(len(probes), bool)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == keys).tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == keys[i] and not out[i]:
                start = int(self.ends[k - 1]) if k else 0
                out[i] = self.text[start : int(self.ends[k])].tobytes() == probes[i]
                k += 1
        return out


_open: dict[str, Index] = {}


def opened(payload: bytes, name: str) -> Index:
    """The index as a file of this machine's temporary folder, written once and mapped by all workers.

    `name` is the digest of the payload; a file that doesn't have it is written again.
    """
    if name not in _open:
        path = os.path.join(tempfile.gettempdir(), f"url-index-{name}")
        if not os.path.exists(path) or _digest(path) != name:
            with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as f:
                f.write(payload)
            os.replace(f.name, path)
        _open[name] = Index(path)
    return _open[name]


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def host_and_path(url: bytes) -> tuple[bytes, bytes]:
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    rest = re.split(rb"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(LOWER_TABLE), slash + path


def labels_of(rule: bytes) -> int:
    """The labels of a rule's host."""
    return rule.partition(b"/")[0].count(b".") + 1


def probes_of(url: bytes, lengths: list[int] | None = None, most_labels: int | None = None) -> tuple[bytes, bytes, list[bytes]]:
    """Host, path, and the strings that a list may hold for them: host suffixes with begins of the path (of the given lengths, else all), words of the host.

    Suffixes have `most_labels` labels at most, as many as the longest listed
    host has, so that a host of very many labels costs no more than its length.
    """
    host, path = host_and_path(url)
    labels = host.rsplit(b".", most_labels) if most_labels is not None else host.split(b".")
    if most_labels is not None and len(labels) > most_labels:
        labels = labels[1:]  # what is left of the longest suffix
    begins = [path[:n] for n in (lengths if lengths is not None else range(1, len(path) + 1)) if len(path) >= n]
    out = [b".".join(labels[k:]) + b for k in range(len(labels)) for b in begins]
    return host, path, out + [_TERM + w for w in _WORDS.findall(host)]


@dataclass(frozen=True)
class Filter:
    """Rules as (verdict, host and path begin) and terms, ready to judge columns."""

    rules: tuple[tuple[str, str], ...] = RULES
    terms: tuple[str, ...] = TERMS

    def judge(self, spark: SparkSession, url: Column) -> Column:
        """struct(host, path, rule, verdict) of a URL column."""
        payload = serialise([r.encode() for _, r in self.rules] + [_TERM + t.encode() for t in self.terms])
        name = hashlib.sha256(payload).hexdigest()
        shipped = spark.sparkContext.broadcast(payload)
        verdicts = {r.encode(): v for v, r in sorted(self.rules)[::-1]}  # of two verdicts of one rule `block` comes last
        verdicts |= {r.encode(): v for v, r in self.rules if v == "block"}
        lengths = sorted({len(r.encode().removeprefix(r.encode().partition(b"/")[0])) for _, r in self.rules}, reverse=True)
        most_labels = max((labels_of(r.encode()) for _, r in self.rules), default=0)
        kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

        @F.arrow_udf("struct<host:string,path:string,rule:string,verdict:string>")
        def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = opened(shipped.value, name)
            for urls in batches:
                probes, owner, parts = [], [], []
                for i, url in enumerate(as_bytes(urls)):
                    host, path, own = probes_of(url, lengths, most_labels)
                    parts.append((host, path))
                    probes += own
                    owner += [i] * len(own)
                rule: list[bytes | None] = [None] * len(parts)
                bad = [False] * len(parts)
                for j in np.flatnonzero(index.find(probes)).tolist():
                    i, hit = owner[j], probes[j]
                    if hit.startswith(_TERM):
                        bad[i] = True
                    elif rule[i] is None or (-len(hit), hit) < (-len(rule[i]), rule[i]):
                        rule[i] = hit
                rows = [(h, p, r, verdicts[r] if r is not None else "block" if b else "allow") for (h, p), r, b in zip(parts, rule, bad, strict=True)]
                yield pa.array([{"host": _text(h), "path": _text(p), "rule": _text(r), "verdict": v} for h, p, r, v in rows], kind)

        return judged(url)


def _text(x: bytes | None) -> str | None:
    return None if x is None else x.decode("utf-8", "replace")


def judge_by_tables(pages: DataFrame, rules: DataFrame, terms: DataFrame, url: str = "url", most: int = MOST_INDEX_BYTES) -> DataFrame:
    """`pages` with the column `judged`, struct(host, path, rule, verdict), by tables of rules (verdict, rule) and terms (term)."""
    spark = pages.sparkSession
    listed = rules.groupBy("rule").agg(F.max("verdict").alias("verdict")).select("verdict", "rule")  # `block` is after `allow`
    words = terms.select("term").distinct()
    size = listed.select(F.col("rule").alias("s")).unionByName(words.select(F.col("term").alias("s"))).agg(F.coalesce(F.sum(F.octet_length("s") + 24), F.lit(0))).first()[0]
    if size <= most:
        chosen = Filter(tuple((v, r) for v, r in listed.collect()), tuple(r[0] for r in words.collect()))
        return pages.withColumn("judged", chosen.judge(spark, F.col(f"`{url}`")))

    # rules' paths have few lengths; only begins of these are looked for
    lengths = sorted((r[0] for r in listed.select(F.octet_length(F.regexp_replace("rule", "^[^/]*", "")).alias("n")).distinct().collect()), reverse=True)
    most_labels = listed.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), "\\.")))).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                urls = batch.column(0).slice(at, 1000)
                found = [probes_of(u, lengths, most_labels) for u in as_bytes(urls)]
                owner = np.repeat(np.arange(len(found)), [len(f[2]) for f in found])
                yield pa.RecordBatch.from_arrays([urls.take(pa.array(owner)), pa.array([_text(p) for f in found for p in f[2]], pa.string())], names=["u", "probe"])

    probes = pages.select(F.col(f"`{url}`").alias("u")).filter("u IS NOT NULL").distinct().mapInArrow(cut, "u string, probe string")
    strings = listed.select(F.col("rule").alias("probe"), "verdict").unionByName(words.select(F.concat(F.lit(_TERM.decode()), "term").alias("probe"), F.lit("term").alias("verdict")))
    hits = probes.join(strings, "probe")
    is_term = F.col("verdict") == "term"
    best = F.min(F.when(~is_term, F.struct((-F.octet_length("probe")).alias("n"), F.col("probe").alias("rule"), F.col("verdict"))))
    per_url = hits.groupBy(F.col("u").alias("_url")).agg(best.alias("_best"), F.max(is_term).alias("_bad"))
    plain = Filter((), ()).judge(spark, F.col(f"`{url}`"))  # host and path
    joined = pages.withColumn("judged", plain).join(per_url, F.col(f"`{url}`") == F.col("_url"), "left")
    verdict = F.coalesce(F.col("_best.verdict"), F.when(F.col("_bad"), "block"), F.lit("allow"))
    return joined.withColumn("judged", F.struct(F.col("judged.host").alias("host"), F.col("judged.path").alias("path"), F.col("_best.rule").alias("rule"), verdict.alias("verdict"))).drop("_url", "_best", "_bad")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", Filter().judge(spark, F.col("url")).alias("j")).select("page_id", "j.*")


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1) ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[.\-_:@])(casino|escort|pills|porn|viagra|warez|xxx)($|[.\-_:@])') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
