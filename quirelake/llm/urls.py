"""URL filtering by a sorted digest array.

The rules' keys, host and path, are hashed to 64 bits and sorted; the full strings lie beside them. Each
Python worker writes the array to a nameless file of its own and maps it into memory, so that nothing
touches a folder or is left behind. URLs are judged a batch at a
time: the keys that might fit are hashed, found by binary search over all at once, and each
hit is confirmed by comparing the stored string.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import cut_lineage, in_arrow, refuse_clash

#: Bytes of an index up to which it is broadcast.
MAX_BYTES = 256 << 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class DigestIndex:
    """digests: sorted hashes; offsets, strings, verdicts: in the same order; lengths: how long the rules' paths are, by host digest."""

    digests: bytes
    offsets: bytes
    strings: bytes
    verdicts: tuple[str, ...]
    verdict_of: bytes
    hosts: bytes
    host_offsets: bytes
    lengths: bytes

    @property
    def size(self) -> int:
        return sum(len(x) for x in (self.digests, self.offsets, self.strings, self.verdict_of, self.hosts, self.host_offsets, self.lengths))


def build_index(rules: list[Rule]) -> DigestIndex:
    """Rules with the same host and path are one; the first verdict stands."""
    first: dict[tuple[str, str], str] = {}
    for r in rules:
        first.setdefault((r.host, r.path), r.verdict)
    verdicts = tuple(sorted(set(first.values())))
    rows = sorted((xxhash.xxh64_intdigest(f"{h}\0{p}"), f"{h}\0{p}".encode(), verdicts.index(v)) for (h, p), v in first.items())
    lengths: dict[int, set[int]] = {}
    for h, p in first:
        lengths.setdefault(xxhash.xxh64_intdigest(h), set()).add(len(p))
    hosts = sorted(lengths)
    return DigestIndex(
        np.array([r[0] for r in rows], np.uint64).tobytes(),
        np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int64).tobytes(),
        b"".join(r[1] for r in rows),
        verdicts,
        np.array([r[2] for r in rows], np.uint8).tobytes(),
        np.array(hosts, np.uint64).tobytes(),
        np.cumsum([0, *(len(lengths[h]) for h in hosts)]).astype(np.int64).tobytes(),
        np.array([n for h in hosts for n in sorted(lengths[h])], np.int32).tobytes(),
    )


def _mapped(data: bytes, kind: type) -> np.ndarray:
    """The bytes as an array over a memory-mapped file without a name or a folder."""
    if not data:
        return np.empty(0, kind)
    handle = os.memfd_create("digests")
    try:
        with os.fdopen(os.dup(handle), "wb") as f:
            f.write(data)
        return np.frombuffer(mmap.mmap(handle, len(data), access=mmap.ACCESS_READ), kind)
    finally:
        os.close(handle)


class Prober:
    """A mapped index; find() looks up many keys at once."""

    def __init__(self, index: DigestIndex):
        self.digests, self.offsets = _mapped(index.digests, np.uint64), _mapped(index.offsets, np.int64)
        self.strings, self.verdict_of = _mapped(index.strings, np.uint8), _mapped(index.verdict_of, np.uint8)
        self.hosts, self.host_offsets, self.lengths = _mapped(index.hosts, np.uint64), _mapped(index.host_offsets, np.int64), _mapped(index.lengths, np.int32)
        self.verdicts = index.verdicts

    def path_lengths(self, hosts: list[str]) -> list[list[int]]:
        """For each host the lengths of paths to try; a collision of host digests only adds lengths."""
        if not hosts or not len(self.hosts):
            return [[] for _ in hosts]
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, hosts), np.uint64, len(hosts))
        at = np.minimum(np.searchsorted(self.hosts, wanted), len(self.hosts) - 1)
        hit = self.hosts[at] == wanted
        return [self.lengths[self.host_offsets[i] : self.host_offsets[i + 1]].tolist() if h else [] for i, h in zip(at.tolist(), hit.tolist(), strict=True)]

    def find(self, keys: list[str]) -> list[int]:
        """Row of each key, or -1. Rows with one digest lie together and are all compared."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        low, high = np.searchsorted(self.digests, wanted), np.searchsorted(self.digests, wanted, side="right")
        found = np.full(len(keys), -1)
        for k in np.flatnonzero(high > low).tolist():
            key = keys[k].encode()
            for row in range(low[k], high[k]):
                if self.strings[self.offsets[row] : self.offsets[row + 1]].tobytes() == key:
                    found[k] = row
                    break
        return found.tolist()

    def judge(self, hosts: list[str], paths: list[str], suffixes: bool = True) -> list[tuple[str, str] | None]:
        """(rule, verdict) of each URL's longest fitting rule, of its host alone without suffixes; the longer host of two rules equally long."""
        ends, owner = [], []
        for i, host in enumerate(hosts):
            while host:
                ends.append(host)
                owner.append(i)
                host = host.partition(".")[2] if suffixes else ""
        keys, whose = [], []
        for end, i, lengths in zip(ends, owner, self.path_lengths(ends), strict=True):
            path = paths[i]
            for n in lengths:
                if n <= len(path):
                    keys.append(f"{end}\0{path[:n]}")
                    whose.append(i)
        best: list[tuple[int, int, str, str] | None] = [None] * len(hosts)
        for key, i, row in zip(keys, whose, self.find(keys) if len(self.digests) else [-1] * len(keys), strict=True):
            if row >= 0:
                name = key.replace("\0", "", 1)
                mark = (len(name), key.index("\0"), name, self.verdicts[self.verdict_of[row]])
                if best[i] is None or mark[:2] > best[i][:2]:
                    best[i] = mark
        return [b and b[2:] for b in best]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path after the first "://"; both empty if there is none or url is null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def filter_urls(df: DataFrame, rules: list[Rule], keys: list[str], url: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The key columns with host, path, rule and verdict of each row's url.

    A rule fits its host and that host's subdomains where the path starts with the rule's; the longest
    rule wins. Without one, rule is null and the verdict is default. Null URLs and such without "://" have empty host and path and
    fit no rule. Repeated rows stay. An empty table gives an empty one; other columns are not read, and
    keys may have any names but the four that come out (else ValueError). The index is broadcast up to max_bytes; larger ones are dealt out by digest (_shuffled), with the same result.
    """
    refuse_clash(keys, ["host", "path", "rule", "verdict"])
    index = build_index(rules)
    if index.size > max_bytes:
        return _shuffled(df, rules, keys, url, default, max(2, -(-index.size // max_bytes)))
    shared = df.sparkSession.sparkContext.broadcast(index)
    host, path = host_and_path(F.col(f"`{url}`"))
    narrow = df.select(*[F.col(f"`{k}`") for k in keys], host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = Prober(shared.value)
        for batch in batches:
            judged = prober.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            rule = pa.array([j and j[0] for j in judged], pa.string())
            verdict = pa.array([j[1] if j else default for j in judged], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*keys, "host", "path", "rule", "verdict"])

    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    return in_arrow(narrow, run, f"{kinds}, host string, path string, rule string, verdict string")


def _shuffled(df: DataFrame, rules: list[Rule], keys: list[str], url: str, default: str, shards: int) -> DataFrame:
    """filter_urls for rules over the bound of a broadcast: rules and hosts' suffixes are dealt to shards by the suffix's digest.

    Each shard's rules make a sorted digest array of their own, broadcast by itself and probed in a pass over the URLs' suffixes
    of that shard, so that no worker holds more than one. A URL's best rule is the longest that any shard found.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = df.select(*[F.col(f"`{k}`") for k in keys], host.alias("host"), path.alias("path")).withColumn("__row", F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    probes = rows.filter("host <> ''").select("__row", "path", F.explode(ends).alias("end")).filter("end <> ''").withColumn("shard", F.pmod(F.xxhash64("end"), F.lit(shards)).cast("int"))
    probes = cut_lineage(probes)
    names = sorted({r.host for r in rules})
    spark = df.sparkSession
    dealt = spark.createDataFrame([(n,) for n in names], "end string").select("end", F.pmod(F.xxhash64("end"), F.lit(shards)).cast("int").alias("shard")).collect()
    shard_of = {r["end"]: r["shard"] for r in dealt}
    found = None
    for k in range(shards):
        own = [r for r in rules if shard_of[r.host] == k]
        if not own:
            continue
        shared = spark.sparkContext.broadcast(build_index(own))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            prober = Prober(shared.value)
            for batch in batches:
                judged = prober.judge(batch.column("end").to_pylist(), batch.column("path").to_pylist(), suffixes=False)
                hit = [i for i, j in enumerate(judged) if j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__row").take(pa.array(hit, pa.int64())), pa.array([len(judged[i][0]) for i in hit], pa.int32()), batch.column("end").take(pa.array(hit, pa.int64())), pa.array([judged[i][0] for i in hit], pa.string()), pa.array([judged[i][1] for i in hit], pa.string())],
                    names=["__row", "n", "end", "rule", "verdict"],
                )

        part = cut_lineage(in_arrow(probes.filter(F.col("shard") == k).select("__row", "path", "end"), run, "__row long, n int, end string, rule string, verdict string"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(*keys, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    best = found.groupBy("__row").agg(F.max(F.struct("n", F.length("end").alias("host_n"), "rule", "verdict")).alias("best"))
    return rows.join(best, "__row", "left").select(*keys, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, coalesce(rest, '') as rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') as h from a),
c as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from b),
r(rule_host, rule_path, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select page_id, host, path, rule_host || rule_path as rule, v, row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last, length(rule_host) desc) as k
      from c left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where k = 1
"""
