"""URL rules in sorted digest arrays.

A list of rules (host and path prefix, allow or block) is sorted by the 64-bit xxHash of
its rule strings and stored in files: digests, then the full strings.  Tasks map the files
into memory, probe them with a vectorised binary search and confirm every hit against the
stored string, so equal digests cannot decide anything.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tannin.llm.words import ascii_lower
from tannin.sources import sinks

#: Seed of Spark's own xxhash64 function, so both sides agree.
SEED = 42
ALLOW, BLOCK = "allow", "block"
_HEADER = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def write_list(rules: DataFrame, folder: str | None = None) -> DataFrame:
    """Store a list of rules (host, path, verdict) as digest files.

    Hosts are taken in lower case (A-Z); rules with a null part are left out, and of equal
    rules block wins.  Rows are dealt by ranges of their digests, so the list may be of any
    size; each task writes one file into ``folder``, which all executors share (by default
    a new one in ``spark.checkpoint.dir``).  Result: the stored list of files (file,
    lengths: the lengths of the paths in it).
    """
    folder = folder or sinks.scratch_path(rules.sparkSession, "urls")
    host = ascii_lower(F.col("host"))
    rows = rules.dropna(subset=["host", "path", "verdict"]) \
        .select(F.concat(host, "path").alias("rule"), F.length("path").alias("length"),
                (F.col("verdict") == BLOCK).alias("block")) \
        .groupBy("rule", "length").agg(F.max("block").alias("block")) \
        .withColumn("digest", F.xxhash64("rule"))
    # as unsigned numbers, the negative digests are the larger half
    order = [F.col("digest") < 0, "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        rules = table.column("rule").combine_chunks().cast(pa.large_binary())
        n = len(rules)
        files, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        name = f"digests-{uuid.uuid4().hex}.urls"
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(np.array([n, 0], "<u8").tobytes())
            out.write(table.column("digest").to_numpy().astype("<i8").tobytes())
            ends = np.frombuffer(rules.buffers()[1], np.int64)[rules.offset:rules.offset + n + 1]
            out.write((ends - ends[0]).astype("<u8").tobytes())
            out.write(np.asarray(table.column("block").to_numpy(), np.uint8).tobytes())
            out.write(b"".join(rules.to_pylist()))
        lengths = sorted(set(table.column("length").to_pylist()))
        yield pa.RecordBatch.from_pylist(
            [{"file": f"{folder.rstrip('/')}/{name}", "lengths": lengths}],
            pa.schema([("file", pa.string()), ("lengths", pa.list_(pa.int32()))]))

    return sinks.materialize(dealt.mapInArrow(write, "file string, lengths array<int>"))


class DigestArray:
    """One mapped file of rules."""

    def __init__(self, path: str):
        size = os.path.getsize(path)
        self.n = int(np.fromfile(path, "<u8", 1)[0])
        at = _HEADER
        self.digests = np.memmap(path, "<u8", "r", at, (self.n,))
        self.ends = np.memmap(path, "<u8", "r", at + 8 * self.n, (self.n + 1,))
        at += 16 * self.n + 8
        self.block = np.memmap(path, np.uint8, "r", at, (self.n,))
        at += self.n
        self.text = np.memmap(path, np.uint8, "r", at, (size - at,)) if size > at else np.zeros(0, np.uint8)

    def find(self, digests: np.ndarray, rules: list[bytes]) -> np.ndarray:
        """The place of each rule string in the file, -1 if it is not there."""
        at = np.searchsorted(self.digests, digests)
        found = np.full(len(digests), -1)
        hit = np.flatnonzero(self.digests[np.minimum(at, self.n - 1)] == digests) if self.n else []
        for i in hit:
            place = int(at[i])
            # different strings may share a digest
            while place < self.n and self.digests[place] == digests[i]:
                if self.text[int(self.ends[place]):int(self.ends[place + 1])].tobytes() == rules[i]:
                    found[i] = place
                    break
                place += 1
        return found


_MAPPED: dict[str, DigestArray] = {}


def _mapped(path: str) -> DigestArray:
    if path not in _MAPPED:
        local = _local(path)
        if ":/" in local:  # a store that cannot be mapped: a copy for this process
            files, source = fs.FileSystem.from_uri(path)
            copy = tempfile.NamedTemporaryFile(prefix="urls-", delete=True)  # noqa: SIM115
            with files.open_input_stream(source) as stream:
                shutil.copyfileobj(stream, copy)
            copy.flush()
            _MAPPED[path] = DigestArray(copy.name)
            copy.close()  # the mapping stays
        else:
            _MAPPED[path] = DigestArray(local)
    return _MAPPED[path]


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Rule strings that fit a URL, the longest first: host suffixes and path prefixes."""
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1:])
        at = host.find(".", at + 1)
    found = [(s, path[:n]) for s in suffixes for n in lengths if n <= len(path)]
    found.sort(key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    return [s + p for s, p in found]


def judge_urls(pages: DataFrame, files: DataFrame, default: str = ALLOW) -> DataFrame:
    """The verdict of the longest fitting rule on each URL.

    A rule fits its host and all subdomains, if the URL's path starts with the rule's; of
    two as long, the longer host wins.  ``files`` is the result of ``write_list``: a row
    per file.  A URL that no stored rule fits gets ``default`` and a null rule: by this
    method what is not in the array is not listed.

    Result: page_id, host, path, rule, verdict, a row per row of ``pages``; other columns
    are not read.  A null URL and one without ``://`` have an empty host and path.
    """
    listed = [(r["file"], list(r["lengths"])) for r in files.collect()]  # a row per file
    lengths = sorted({n for _, each in listed for n in each})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_mapped(f) for f, _ in listed]
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            probes = [candidates(h, p, lengths) for h, p in zip(hosts, paths)]
            flat = [r.encode() for each in probes for r in each]
            digests = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in flat), np.uint64, len(flat))
            verdict = np.full(len(flat), -1)
            for held in arrays:
                found = held.find(digests, flat)
                hit = found >= 0
                verdict[hit] = held.block[found[hit]]
            rules, verdicts, at = [], [], 0
            for each in probes:
                hit = np.flatnonzero(verdict[at:at + len(each)] >= 0)
                rules.append(each[hit[0]] if len(hit) else None)
                verdicts.append((BLOCK if verdict[at + hit[0]] else ALLOW) if len(hit) else default)
                at += len(each)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                [*batch.schema.names, "rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return read.mapInArrow(
        judge, f"page_id {kind}, host string, path string, rule string, verdict string")
