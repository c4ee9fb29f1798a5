"""URL filters looked up in a sorted digest array.

A list of strings (rules, hosts, URLs) is written to the shared folder as three files: the sorted 64-bit xxHash keys,
the offsets of the strings in the same order, and the strings themselves. Tasks map the files into memory, look up a whole
batch of probes by vectorised binary search, and compare the stored string wherever a key agrees, so a hash collision
never decides.

Rules are ``host + path``; a rule fits its host and all subdomains where the URL's path starts with the rule's. The probes of a URL are
its host and every parent domain, each with every prefix of its path that has the length of some rule's path. The longest fitting
rule wins; of two equally long ones, that with the longer host.

URLs without a rule are blocked where their host is on the list of mirror hosts: hosts whose pages mostly repeat, byte for byte, pages
of other hosts.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and is allowed; repeated rows are judged
one by one; an empty list fits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm.text import LONG, LOWER, STRING, record
from searchloom.session import cut_lineage, scratch_path

# Rule and verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
SEED = 0


def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, SEED)


class DigestArray:
    """A mapped list of distinct strings; ``find`` gives each probe's place in it or -1."""

    def __init__(self, folder: str):
        self.keys, self.offsets, self.strings = (_mapped(f"{folder}/{name}", kind) for name, kind in FILES)

    def find(self, probes: list[bytes]) -> np.ndarray:
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys) or not probes:
            return out
        hashes = np.fromiter(map(digest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, hashes)
        # equal keys stand side by side: the stored strings tell them apart
        open_ = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == hashes))
        while len(open_):
            more = []
            for i in open_.tolist():
                place = int(at[i])
                if self.string(place) == probes[i]:
                    out[i] = place
                elif place + 1 < len(self.keys) and self.keys[place + 1] == hashes[i]:
                    at[i] = place + 1
                    more.append(i)
            open_ = np.array(more, np.int64)
        return out

    def string(self, place: int) -> bytes:
        return self.strings[int(self.offsets[place]) : int(self.offsets[place + 1])].tobytes()


FILES = (("keys.u64", "<u8"), ("offsets.u64", "<u8"), ("strings.bin", "u1"))


def _store(folder: str):
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def _mapped(path: str, kind: str) -> np.ndarray:
    store, local = _store(path)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(local, kind, "r") if os.path.getsize(local) else np.empty(0, kind)
    with store.open_input_file(local) as file:
        return np.frombuffer(file.read(), kind)


_ARRAYS: dict[str, DigestArray] = {}


def digest_array(folder: str) -> DigestArray:
    """The mapped list, once per Python worker."""
    if folder not in _ARRAYS:
        _ARRAYS[folder] = DigestArray(folder)
    return _ARRAYS[folder]


def write_digest_array(entries: Iterator[bytes], folder: str) -> str:
    """Write distinct ``entries`` as a digest array; returns ``folder``."""
    strings = sorted({e for e in entries}, key=lambda e: (digest(e), e))
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings))))).astype("<u8")
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    contents = (np.fromiter(map(digest, strings), "<u8", len(strings)).tobytes(), offsets.tobytes(), b"".join(strings))
    for (name, _), content in zip(FILES, contents):
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(content)
    return folder


# strings of one list file; longer lists are dealt by key over more files
SHARD = 2_000_000


def write_list(strings: DataFrame, name: str) -> list[str]:
    """A list of any length (one string column) as digest arrays of about ``SHARD`` strings, written by tasks.

    A string's file follows from its hash. Returns the folders in order.
    """
    spark = strings.sparkSession
    column = strings.columns[0]
    distinct = cut_lineage(strings.select(F.col(column).alias("entry")).where("entry is not null").distinct(), "llm-list")
    shards = max(1, -(-distinct.count() // SHARD))
    folder = scratch_path(spark, name)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, list[bytes]] = {}
        for frame in batches:
            for entry in frame["entry"]:
                raw = entry.encode()
                own.setdefault(digest(raw) % shards, []).append(raw)
        for shard, entries in own.items():
            write_digest_array(iter(entries), f"{folder}/{shard}")
        yield pd.DataFrame({"shard": list(own)}, dtype="int64")

    def numbered(entries: pd.Series) -> pd.Series:
        return pd.Series([digest(e.encode()) % shards for e in entries], dtype="int64")

    dealt = distinct.withColumn("_shard", F.pandas_udf(numbered, LONG)("entry")).repartition(shards, "_shard").select("entry")
    there = {r["shard"] for r in dealt.mapInPandas(write, "shard bigint").toLocalIterator()}
    for shard in set(range(shards)) - there:
        write_digest_array(iter(()), f"{folder}/{shard}")
    return [f"{folder}/{shard}" for shard in range(shards)]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.encode().translate(LOWER).decode(), tail[:cut]


def domains(host: str) -> list[str]:
    """A host and its parent domains, longest first."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def mirror_hosts(pages: DataFrame, url: str = "url", html: str = "html", least: int = 20, share: float = 0.5) -> DataFrame:
    """Hosts with at least ``least`` pages of which more than ``share`` have the bytes of a page of another host.

    Pages are reduced to digests and counted per digest and host before anything meets; a digest on very many hosts is one row per
    host.
    """
    host = F.translate(F.regexp_extract(F.col(f"`{url}`"), r"(?s)^.*?://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    seen = pages.where(F.col(f"`{url}`").contains("://")).select(host.alias("host"), F.sha2(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), 256).alias("d"))
    counts = seen.groupBy("host", "d").agg(F.count("*").alias("n"))
    spread = counts.groupBy("d").agg(F.count("*").alias("hosts")).where("hosts > 1").select("d", F.lit(1).alias("again"))
    known = counts.join(spread, "d", "left").groupBy("host").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("again") == 1, F.col("n")).otherwise(0)).alias("copies")
    )
    return known.where((F.col("n") >= least) & (F.col("copies") > share * F.col("n"))).select("host")


VERDICT = record(host=STRING, path=STRING, rule=STRING, verdict=STRING)


def judge(pages: DataFrame, blocked: DataFrame, page_id: str = "page_id", url: str = "url", rules: dict[str, str] | None = None) -> DataFrame:
    """``page_id`` and ``judged`` (host, path, rule, verdict) of every row; ``blocked`` lists hosts that the method blocks with their subdomains."""
    spark: SparkSession = pages.sparkSession
    table = RULES if rules is None else rules
    rule_file = write_digest_array((r.encode() for r in table), scratch_path(spark, "llm-url-rules"))
    lengths = sorted({len(r) - len(r.split("/", 1)[0]) for r in table})
    host_files = write_list(blocked, "llm-url-hosts")

    @F.pandas_udf(VERDICT)
    def decided(urls: pd.Series) -> pd.DataFrame:
        split = [split_url(u) for u in urls]
        owners, probes = [], []
        for i, (host, path) in enumerate(split):
            for domain in domains(host):
                for n in lengths:
                    if len(path) >= n:
                        owners.append(i)
                        probes.append((domain + path[:n]).encode())
        array = digest_array(rule_file)
        best: list[str | None] = [None] * len(split)
        for i, probe, place in zip(owners, probes, array.find(probes).tolist()):
            # probes run from the longest host on, so the first of two equally long rules stays
            if place >= 0 and (best[i] is None or len(probe.decode()) > len(best[i])):
                best[i] = probe.decode()
        listed = on_list(host_files, [host for host, _ in split])
        verdicts = [table[r] if r else "block" if b else "allow" for r, b in zip(best, listed)]
        return pd.DataFrame({"host": [h for h, _ in split], "path": [p for _, p in split], "rule": best, "verdict": verdicts}, dtype=object)

    return pages.select(F.col(f"`{page_id}`").alias("page_id"), decided(F.col(f"`{url}`").cast("string")).alias("judged"))


def on_list(folders: list[str], hosts: list[str]) -> list[bool]:
    """Whether each host or one of its parent domains is on a list; a probe opens only the file its hash belongs to."""
    out = [False] * len(hosts)
    dealt: dict[int, tuple[list[int], list[bytes]]] = {}
    for i, host in enumerate(hosts):
        for domain in domains(host):
            raw = domain.encode()
            owners, probes = dealt.setdefault(digest(raw) % len(folders), ([], []))
            owners.append(i)
            probes.append(raw)
    for shard, (owners, probes) in dealt.items():
        places = digest_array(folders[shard]).find(probes)
        for k in np.flatnonzero(places >= 0).tolist():
            out[owners[k]] = True
    return out
