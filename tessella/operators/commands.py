"""The command language over a cluster tree: one line of text to one DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _versions, livetree
from . import clusters as tree
from ._cut import stored
from .stats import profile

#: Fixed command words.
VERBS = ("GET", "SET", "DEL", "SCAN", "ANCESTORS", "COUNTERFACTUAL", "LFD", "CRP", "NARS", "SHIFT", "ANOMALY", "MGET", "MSCAN")
ADDRESS = re.compile(r"ada:clam((?::[0-9a-fA-F]){1,4})(:\*)?")


@dataclass(frozen=True)
class Command:
    verb: str
    paths: tuple[tuple[int, int], ...] = ()
    rest: str = ""


def parse_path(address: str) -> tuple[int, int]:
    """(bits, depth) of `ada:clam:a:b`: one hex nibble a segment, four at most."""
    found = ADDRESS.fullmatch(address)
    if not found:
        raise ValueError(f"not an address: {address!r}")
    digits = found[1].replace(":", "")
    return int(digits.ljust(4, "0"), 16), 4 * len(digits)


def parse(text: str) -> Command:
    words = text.split()
    if not words or words[0].upper() not in VERBS:
        raise ValueError(f"unknown command: {text!r}")
    verb, many = words[0].upper(), words[0].upper() in ("MGET", "MSCAN")
    if len(words) < 2:
        raise ValueError(f"{verb} needs an address")
    return Command(verb, tuple(parse_path(w) for w in (words[1:] if many else words[1:2])), "" if many else " ".join(words[2:]))


def execute(command: str | Command, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """GET, MGET: the deepest real prefix with confidence and gate; SCAN, MSCAN: clusters below;
    ANCESTORS, COUNTERFACTUAL: every prefix, every single flip; LFD, CRP, NARS, SHIFT, ANOMALY:
    analyses of the prefix; DEL, SET: the cluster they would touch (see execute_on for a tree that
    changes)."""
    c = parse(command) if isinstance(command, str) else command
    parts = [_one(c.verb, clusters, members, bits, depth) for bits, depth in c.paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def execute_on(spark: SparkSession, command: str | Command, path: str) -> DataFrame:
    """A command on the last version of a tree that changes (livetree), which SET and DEL make a new one of.

    `SET address id hex`, with 16 hex digits a lane, tells what the arrival does there and, if its
    gate is flow, stores it; `DEL address` drops every member under the address. Both return the
    version after them. All other commands read (see execute).
    """
    c = parse(command) if isinstance(command, str) else command
    if c.verb not in ("SET", "DEL"):
        return execute(c, *livetree.snapshot(spark, path))
    (bits, depth), (nodes, members) = c.paths[0], livetree.snapshot(spark, path)
    version, manifest = _versions.read(spark, path)
    if c.verb == "DEL":
        gone = stored(members.where(livetree.under(bits, depth)).select("id"), "command-del")
        removed = gone.count()
        if removed:
            version = livetree.change(spark, path, drop=gone)
        return spark.createDataFrame([(f"{bits:04x}/{depth}", removed, version)], "asked string, removed long, version long")
    words = c.rest.split()
    if len(words) != 2 or not re.fullmatch(f"[0-9a-fA-F]{{{16 * manifest['lanes']}}}", words[1]):
        raise ValueError(f"SET needs an address, an id and {16 * manifest['lanes']} hex digits")
    lanes = [int(words[1][i : i + 16], 16) for i in range(0, len(words[1]), 16)]
    kind = members.schema["id"].dataType
    row = spark.createDataFrame([(words[0], [x - (1 << 64) if x >> 63 else x for x in lanes], bits, depth)], "id string, fp array<long>, path int, steps int").withColumn("id", F.col("id").cast(kind))
    told = stored(livetree.arrivals(nodes, members, row, manifest["lanes"]), "command-set")
    found = told.select("gate").first()
    if found is not None and found.gate == "flow":
        version = livetree.change(spark, path, add=row.select("id", "fp"))
    return told.withColumn("version", F.lit(version))


def _one(verb: str, clusters: DataFrame, members: DataFrame, bits: int, depth: int) -> DataFrame:
    best = tree.deepest(clusters, bits, depth)
    asked = F.lit(f"{bits:04x}/{depth}").alias("asked")
    if verb in ("GET", "MGET", "SET", "DEL"):
        confidence = F.col("depth") / F.lit(float(depth))
        gate = F.when(confidence > 0.8, "flow").when(confidence > 0.5, "hold").otherwise("block")
        return best.select(asked, "node", "depth", "n", "radius", confidence.alias("confidence"), gate.alias("gate"))
    if verb in ("SCAN", "MSCAN"):
        return tree.below(clusters, bits, depth).select(asked, "node", "depth", "n", "radius")
    if verb == "ANCESTORS":
        return tree.above(clusters, bits, depth).select(asked, "node", "depth", "n", "radius")
    if verb == "COUNTERFACTUAL":
        flips = clusters.sparkSession.range(depth).select((F.lit(bits).bitwiseXOR(F.call_function("shiftleft", F.lit(1), (15 - F.col("id")).cast("int")))).alias("flip"), F.col("id").cast("int").alias("level"))
        free = F.call_function("shiftleft", F.lit(1), (16 - F.col("level") - 1).cast("int")) - 1
        flips = flips.select("level", F.col("flip").bitwiseAND(F.bitwise_not(free)).bitwiseAND(F.lit(0xFFFF)).alias("node"), (F.col("level") + 1).alias("depth"))
        return flips.join(clusters, ["node", "depth"]).select(asked, "level", "node", "depth", "n", "radius")
    if verb == "LFD":
        return best.select(asked, "node", "depth", "lfd")
    if verb == "CRP":
        inside = members.where(F.col("node").between(*tree.path_range(F.lit(bits), F.lit(depth))))
        center = best.select(F.first("center")).scalar()
        bit = lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")
        at = inside.withColumn("c", center).withColumn("d", F.aggregate(F.zip_with("fp", "c", bit), F.lit(0).cast("long"), lambda s, w: s + w))
        return profile(at.withColumn("asked", asked), ["asked"], "d")
    if verb == "NARS":
        share = F.col("n_half") / F.col("n")
        return best.select(asked, "node", "depth", share.alias("frequency"), (F.col("n") / (F.col("n") + 1.0)).alias("confidence"))
    if verb == "SHIFT":
        return best.select(asked, "node", "depth", F.lit("stable").alias("shift"))
    return tree.anomaly(clusters, members).where(F.col("node").between(*tree.path_range(F.lit(bits), F.lit(depth)))).select(asked, "id", "node", "depth", "score", "band")
