"""Facts of Java sources: packages, imports, types, members, call sites, and the graphs from them.

Signatures and calls are taken out with regexes over whole texts, inside generated code.
They see what stands in the text of one file; overloads share one id, as they do in every
table keyed by (file, class, method).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_METHOD = r"(?m)^[ \t]+(?:public|protected|private)\s+(?:static\s+|final\s+|abstract\s+)*([\w<>\[\], ?.]+?)\s+(\w+)\s*\(([^()]*)\)"
_CALL = r"(?:(\b[A-Za-z_]\w*)\s*\.\s*)?\b([a-z]\w*)\s*\("
#: Words before a bracket that call nothing.
_NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "new", "super", "this", "synchronized")


def files(units: DataFrame) -> DataFrame:
    """(unit_id, pos, file_path, class_name, source) of the classes of map units; a null source is the empty text."""
    c = units.select("unit_id", F.posexplode("classes").alias("pos", "c"))
    return c.select("unit_id", "pos", "c.file_path", "c.class_name", F.coalesce("c.source", F.lit("")).alias("source"))


def class_facts(src: DataFrame) -> DataFrame:
    """Package, imports, kind, superclass, interfaces, method count and lines of each source."""
    s = F.col("source")
    head = r"\b(class|interface|enum)\s+(\w+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w<>., ]+?))?(?:\s+implements\s+([\w<>., ]+?))?\s*\{"

    def none_if_empty(c: Column) -> Column:
        return F.when(c != "", c)

    bare = F.regexp_replace(s, r"(?s)/\*.*?\*/|//[^\n]*+", " ")  # a comment declares nothing
    supers = none_if_empty(F.regexp_extract(bare, head, 4))
    return src.select(
        *[c for c in src.columns if c != "source"],
        none_if_empty(F.regexp_extract(s, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)).alias("package"),
        F.regexp_extract_all(s, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"), F.lit(1)).alias("imports"),
        none_if_empty(F.regexp_extract(bare, head, 1)).alias("kind"),
        none_if_empty(F.regexp_extract(bare, head, 2)).alias("declared"),
        none_if_empty(F.trim(F.regexp_extract(bare, head, 3))).alias("extends"),
        F.transform(F.split(F.coalesce(supers, F.lit("")), ","), lambda x: F.trim(x)).alias("implements"),
        F.size(F.regexp_extract_all(s, F.lit(_METHOD), F.lit(2))).alias("methods"),
        F.when(s == "", 0).otherwise(F.size(F.split(s, "\n"))).alias("lines"),
    )


def signatures(src: DataFrame) -> DataFrame:
    """(.., mpos, return_type, method, parameters) of each method in source order."""
    z = F.arrays_zip(
        F.regexp_extract_all("source", F.lit(_METHOD), F.lit(1)).alias("r"),
        F.regexp_extract_all("source", F.lit(_METHOD), F.lit(2)).alias("m"),
        F.regexp_extract_all("source", F.lit(_METHOD), F.lit(3)).alias("p"),
    )
    keep = [c for c in src.columns if c != "source"]
    e = src.select(*keep, F.posexplode(z).alias("mpos", "z"))
    params = F.filter(F.transform(F.split(F.col("z.p"), r",(?![^<]*>)"), lambda x: F.trim(x)), lambda x: x != "")
    return e.select(*keep, "mpos", F.col("z.r").alias("return_type"), F.col("z.m").alias("method"), params.alias("parameters"))


def calls(src: DataFrame) -> DataFrame:
    """(.., target, method, n): calls by receiver and name with their number in the source.

    Comments and string literals are taken out first; declarations are no calls.
    """
    # possessive loops: a long literal must not use up the stack
    bare = F.regexp_replace(F.regexp_replace("source", r"(?s)/\*.*?\*/|//[^\n]*+", " "), r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', '""')
    bare = F.regexp_replace(bare, r"\b(?:public|protected|private)\s[^(){};=]*\([^()]*\)", " ")
    keep = [c for c in src.columns if c != "source"]
    z = F.arrays_zip(F.regexp_extract_all(bare, F.lit(_CALL), F.lit(1)).alias("t"), F.regexp_extract_all(bare, F.lit(_CALL), F.lit(2)).alias("m"))
    e = src.select(*keep, F.explode(z).alias("z")).select(*keep, F.col("z.t").alias("target"), F.col("z.m").alias("method"))
    return e.where(~F.col("method").isin(*_NO_CALLS)).groupBy(*keep, "target", "method").agg(F.count(F.lit(1)).alias("n"))


def import_edges(facts: DataFrame) -> DataFrame:
    """(src, dst): class to imported class of the same tree, by full name."""
    own = F.concat_ws(".", "package", "class_name")
    e = facts.select(own.alias("src"), F.explode("imports").alias("dst"))
    known = facts.select(own.alias("dst")).distinct()
    return e.join(known, "dst", "left_semi").select("src", "dst").distinct()


def method_id(file: Column, cls: Column, method: Column) -> Column:
    """``file::class::method``; a null class is the empty text."""
    return F.concat_ws("::", F.coalesce(file, F.lit("")), F.coalesce(cls, F.lit("")), method)


def implementors(facts: DataFrame) -> DataFrame:
    """(interface, class): each implemented name with each class that implements it."""
    return facts.select(F.explode("implements").alias("interface"), F.col("class_name").alias("class")).where("interface <> ''").distinct()


def type_classes(names: DataFrame, facts: DataFrame) -> DataFrame:
    """(name, class): the implementors of a type, else the class itself; a name of neither has one row with null."""
    imp = implementors(facts).select(F.col("interface").alias("name"), "class")
    own = facts.select(F.col("class_name").alias("name"), F.col("class_name").alias("_own")).distinct()
    return names.join(imp, "name", "left").join(own, "name", "left").select("name", F.coalesce("class", "_own").alias("class"))


def routes(src: DataFrame) -> DataFrame:
    """(.., http_method, route): mapped endpoints, the class's base path times the method's paths."""
    base = F.regexp_extract("source", r'@RequestMapping\(\s*(?:value\s*=\s*)?"([^"]*)"', 1)
    one = r'@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:(?:value|path)\s*=\s*)?"([^"]*)"'
    z = F.arrays_zip(F.regexp_extract_all("source", F.lit(one), F.lit(1)).alias("h"), F.regexp_extract_all("source", F.lit(one), F.lit(2)).alias("p"))
    keep = [c for c in src.columns if c != "source"]
    e = src.select(*keep, base.alias("base"), F.explode(z).alias("z"))
    return e.select(*keep, F.upper("z.h").alias("http_method"), F.regexp_replace(F.concat(F.col("base"), F.lit("/"), F.col("z.p")), "/+", "/").alias("route"))


def method_span(source: str, name: str) -> tuple[int, int] | None:
    """Offsets of the first method of that name from its signature to its closing brace.

    Braces in strings, characters and comments do not count; None without such a method.
    """
    m = re.search(rf"(?m)^[ \t]+(?:public|protected|private)\s[^(){{}};=]*\b{re.escape(name)}\s*\([^()]*\)[^;{{]*\{{", source)
    if not m:
        return None
    depth, i, n = 1, m.end(), len(source)
    skip = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[{}]', re.S)
    while depth and i < n:
        t = skip.search(source, i)
        if not t:
            return None
        depth += (t.group() == "{") - (t.group() == "}")
        i = t.end()
    return (m.start(), i) if not depth else None
