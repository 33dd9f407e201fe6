"""Graph texts to node and edge tables: JSON documents and line-based Cypher scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JSON_GRAPH = "nodes array<struct<id:string,name:string,domain:string>>, edges array<struct<source:string,target:string,relation:string,weight:double>>"


def read_json_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON files with those two lists."""
    doc = spark.read.schema(JSON_GRAPH).json(path, multiLine=True)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def script_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a script without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '//')")


def verbs(lines: DataFrame) -> DataFrame:
    """(verb, n): first words of statements."""
    verb = F.upper(F.regexp_extract("line", r"^([A-Za-z]+)", 1))
    return lines.select(verb.alias("verb")).where("verb <> ''").groupBy("verb").agg(F.count("*").alias("n"))


def _properties(text):
    """map of `key: value` pairs; quotes are taken off."""
    pairs = F.regexp_extract_all(text, F.lit(r"(\w+\s*:\s*(?:'[^']*'|\"[^\"]*\"|[^,}]+))"), F.lit(1))
    key = lambda p: F.trim(F.substring_index(p, ":", 1))
    value = lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"^\s*\w+\s*:\s*", "")), r"^['\"]|['\"]$", "")
    return F.map_from_entries(F.transform(F.filter(pairs, lambda p: p != ""), lambda p: F.struct(key(p), value(p))))


def nodes(lines: DataFrame) -> DataFrame:
    """(alias, label, properties) of every pattern `(alias:Label {...})`."""
    found = lines.select(F.explode(F.regexp_extract_all("line", F.lit(r"(\(\s*\w*\s*:\s*\w+\s*(?:\{[^}]*\})?\s*\))"), F.lit(1))).alias("p"))
    return found.select(
        F.regexp_extract("p", r"^\(\s*(\w*)", 1).alias("alias"),
        F.regexp_extract("p", r":\s*(\w+)", 1).alias("label"),
        _properties(F.regexp_extract("p", r"\{([^}]*)\}", 1)).alias("properties"),
    )


def edges(lines: DataFrame) -> DataFrame:
    """(src, relation, dst, properties) of every pattern `(a)-[:REL {...}]->(b)`."""
    pattern = r"(\(\s*\w+[^)]*\)\s*-\[\s*\w*\s*:\s*\w+\s*(?:\{[^}]*\})?\s*\]->\s*\(\s*\w+)"
    found = lines.select(F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("p"))
    return found.select(
        F.regexp_extract("p", r"^\(\s*(\w+)", 1).alias("src"),
        F.regexp_extract("p", r"-\[\s*\w*\s*:\s*(\w+)", 1).alias("relation"),
        F.regexp_extract("p", r"\]->\s*\(\s*(\w+)$", 1).alias("dst"),
        _properties(F.regexp_extract("p", r"\[[^\]{]*\{([^}]*)\}", 1)).alias("properties"),
    )
