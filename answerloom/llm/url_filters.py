"""Rules for hosts and paths as a sorted array of digests (operator 12).

Every rule is one string, host and path on end. Its 64-bit xxhash goes to a sorted
array that tasks memory-map; the strings lie beside it in the same order. The hosts
above a url's host and the beginnings of its path are the strings to look for: a
vectorised binary search finds their digests, and the stored string confirms each find.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom import files
from answerloom.llm.batches import fresh

#: Rules of one stretch of the array. A task writes a stretch from memory.
STRETCH = 1 << 20
#: The seed of the digests that Spark's function has.
SEED = 42
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Filter:
    """Names of the mapped files in the order of their digests, and which strings can be rules at all.

    ``labels``: numbers of host labels that rules have; ``lengths``: code points of their paths.
    """

    names: tuple[str, ...]
    labels: tuple[int, ...]
    lengths: tuple[int, ...]


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both are empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One blob of all rows of a partition: digests, whether each blocks, ends of the strings, the strings."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    texts = [t.encode() for t in table["key"].to_pylist()]
    blob = files.packed(
        table["digest"].to_numpy(),
        table["blocks"].to_numpy().astype(np.uint8),
        np.cumsum([len(t) for t in texts], dtype=np.int64),
        np.frombuffer(b"".join(texts), np.uint8),
    )
    yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])


def build(rules: DataFrame) -> Filter:
    """The array of a table of rules (host, path, verdict).

    Hosts count without regard to A-Z. Rules with a null field, without a host, or with a path that is neither empty nor
    begins with ``/`` fit no url and are left out; of equal rules with both verdicts the blocking one counts. Other columns are not read. Stretches are made by as
    many tasks, each of about ``STRETCH`` rules, and lie on the disk of every executor; memory holds what is looked at.
    """
    fit = rules.filter((F.col("host") != "") & (F.col("path").startswith("/") | (F.col("path") == "")) & F.col("verdict").isNotNull())
    keyed = fit.select(lowered(F.col("host")).alias("host"), "path", (F.col("verdict") == BLOCK).alias("blocks"))
    keyed = keyed.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), "blocks")
    shape = keyed.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("length").alias("lengths")).first()
    stretches = shape["n"] // STRETCH + 1
    rows = keyed.groupBy("key").agg(F.max("blocks").alias("blocks")).withColumn("digest", F.xxhash64("key"))
    rows = rows.repartitionByRange(stretches, "digest").sortWithinPartitions("digest", "key")
    names = files.handed_out(rows.mapInArrow(_stretch, "blob binary"), "url-digests") if shape["n"] else []
    return Filter(tuple(names), tuple(sorted(shape["labels"])), tuple(sorted(shape["lengths"])))


def digests(keys: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.encode(), SEED) for k in keys], np.uint64).view(np.int64)


class Stretches:
    """The mapped array, in stretches that follow one another by digest."""

    def __init__(self, blobs: Iterable[list[np.ndarray]]):
        read = [(b[0].view(np.int64), b[1], b[2].view(np.int64), b[3]) for b in blobs]
        self.parts = sorted(read, key=lambda p: int(p[0][0]))

    def found(self, keys: list[str], wanted: np.ndarray) -> np.ndarray:
        """For each key 1 if a rule that blocks has it, 0 if another rule has it, -1 if none has. ``wanted``: their digests."""
        verdicts = np.full(len(keys), -1, np.int8)
        for held, blocks, ends, texts in self.parts:
            place = np.searchsorted(held, wanted)
            hits = np.flatnonzero((place < len(held)) & (held[np.minimum(place, len(held) - 1)] == wanted))
            for i in hits.tolist():
                at, key = int(place[i]), keys[i].encode()
                # different strings may have one digest, and then follow one another
                while at < len(held) and held[at] == wanted[i]:
                    if bytes(texts[ends[at - 1] if at else 0 : ends[at]]) == key:
                        verdicts[i] = blocks[at]
                        break
                    at += 1
        return verdicts


def candidates(host: str, path: str, rules: Filter) -> Iterator[str]:
    """The strings that a rule for this url can have, longest first, and of equally long ones that with the longer host first."""
    hosts, at, labels = [], len(host), 0
    while host and at >= 0 and labels < rules.labels[-1]:
        at, labels = host.rfind(".", 0, at), labels + 1
        if labels in rules.labels and at + 1 < len(host):
            hosts.append(host[at + 1 :])
    made = [(len(h) + n, len(h), h + path[:n]) for h in hosts for n in rules.lengths if n <= len(path)]
    return (key for _, _, key in sorted(made, reverse=True))


def verdict_of(rules: Filter, default: str):
    """A function from host and path to a struct (rule, verdict)."""
    kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held = Stretches(blob for name in rules.names for blob in files.mapped(name))
        for hosts, paths in batches:
            keys, ends = [], []
            for host, path in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
                if rules.names:
                    keys.extend(candidates(host, path, rules))
                ends.append(len(keys))
            verdicts = held.found(keys, digests(keys))
            rows, begin = [], 0
            for end in ends:
                hit = begin + int(np.argmax(verdicts[begin:end] >= 0)) if end > begin else end
                fits = hit < end and verdicts[hit] >= 0
                rows.append({"rule": keys[hit], "verdict": BLOCK if verdicts[hit] else ALLOW} if fits else {"rule": None, "verdict": default})
                begin = end
            yield pa.array(rows, kind)

    return judge


def judged(pages: DataFrame, rules: Filter, default: str = ALLOW, url: str = "url") -> DataFrame:
    """All columns and rows of ``pages``, and last a struct (host, path, rule, verdict).

    A rule fits its host and all hosts below it, if the path begins with the rule's;
    the longest rule (host and path together, then the host) decides. A url that no rule
    fits gets ``default`` and a null rule, so does a null or empty one and one without ``://``, whose host and path are empty. Repeated
    rows get the same verdict each, null ids do not matter, a url of any length is looked up by the lengths that rules
    have; the struct's name gives way to columns of ``pages``. There is no shuffle.
    """
    host, path = host_and_path(F.col(url))
    names = [fresh(pages, f"url_{c}") for c in ("host", "path", "verdict")]
    made = pages.withColumn(names[0], host).withColumn(names[1], path)
    made = made.withColumn(names[2], verdict_of(rules, default)(names[0], names[1]))
    both = F.struct(F.col(names[0]).alias("host"), F.col(names[1]).alias("path"), F.col(names[2])["rule"].alias("rule"), F.col(names[2])["verdict"].alias("verdict"))
    return made.withColumn(fresh(pages, "filtered"), both).drop(*names)
