"""JSON-LD documents of a graph's entities, and the triples of such documents.

Documents are built by built-in functions, one aggregation for each entity; a context shortens predicates and types to
its terms and prefixes. Parsing expands them again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import vocabulary as V
from citeweave.sources.members import member_text

QUADS = "g string, s string, p string, o string, o_kind string, o_datatype string, o_lang string"
VALUE = "array<struct<`@id`:string,`@type`:string,`@value`:string,`@language`:string>>"


class Context:
    """A JSON-LD context: terms for IRIs, and prefixes; terms with a type stand for values of that type only."""

    def __init__(self, context: Mapping | None):
        held = dict((context or {}).get("@context", context or {}))
        self.terms = {term: said if isinstance(said, str) else said.get("@id", term) for term, said in held.items() if not term.startswith("@")}
        self.types = {term: said["@type"] for term, said in held.items() if not isinstance(said, str) and "@type" in said}

    def expanded(self, name: str) -> str:
        """The IRI of a term or of a name with a prefix."""
        if name in self.terms and name != self.terms[name]:
            return self.expanded(self.terms[name])
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//") and prefix in self.terms and prefix not in self.types:
            return self.expanded(self.terms[prefix]) + local
        return name

    def plain_terms(self) -> dict[str, str]:
        """Term by IRI, of terms without a type."""
        return {self.expanded(term): term for term in sorted(self.terms, reverse=True) if term not in self.types}

    def shortened(self, iri: Column) -> Column:
        """An IRI's term, or its name with the longest prefix that fits, or the IRI."""
        plain = self.plain_terms()
        exact = F.when(F.lit(False), F.lit(None))
        for full, term in plain.items():
            exact = exact.when(iri == full, F.lit(term))
        for full, term in sorted(plain.items(), key=lambda x: -len(x[0])):
            if full.endswith(("/", "#")):
                exact = exact.when(iri.startswith(full) & (F.length(iri) > len(full)), F.concat(F.lit(term + ":"), F.substring(iri, F.lit(len(full) + 1), F.length(iri))))
        return exact.otherwise(iri)


def entity_documents(quads: DataFrame, context: Mapping | None = None) -> DataFrame:
    """g, s, text: the JSON object of each entity in each graph; quads: g, s, p, o, o_kind, o_datatype, o_lang.

    Values are in order and without repetitions. An entity's triples make one row, as they make one document.
    """
    short = Context(context).shortened if context else lambda c: c
    typed = F.col("p") == V.RDF_TYPE
    value = F.when(F.col("o_kind") == "literal", F.struct(F.lit(None).cast("string").alias("@id"), F.col("o_datatype").alias("@type"), F.col("o").alias("@value"), F.col("o_lang").alias("@language"))).otherwise(
        F.struct(F.col("o").alias("@id"), F.lit(None).cast("string").alias("@type"), F.lit(None).cast("string").alias("@value"), F.lit(None).cast("string").alias("@language"))
    )
    near = quads.repartition("g", "s")  # both aggregations are by more than that
    listed = near.groupBy("g", "s", "p").agg(F.array_sort(F.collect_set(F.when(~typed, value))).alias("values"), F.array_sort(F.collect_set(F.when(typed, short(F.col("o"))))).alias("types"))
    pairs = F.array_sort(F.collect_list(F.when(~typed, F.struct(short(F.col("p")).alias("p"), "values"))))
    rows = listed.groupBy("g", "s").agg(pairs.alias("pairs"), F.flatten(F.collect_list(F.when(typed, F.col("types")))).alias("types"))
    head = F.to_json(F.struct(F.col("s").alias("@id"), F.when(F.size("types") > 0, F.col("types")).alias("@type")))
    body = F.to_json(F.map_from_entries("pairs"))
    text = F.when(F.size("pairs") == 0, head).otherwise(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(","), F.expr("substring(body, 2)")))
    return rows.withColumns({"head": head, "body": body}).select("g", "s", text.alias("text"))


def document_head(context: Mapping | None, context_path: str | None) -> str:
    """What each document begins with: its context, by name if it has one."""
    if not context:
        return ""
    return '"@context":' + json.dumps(context_path or context.get("@context", context), ensure_ascii=False) + ","


def _document_quads(document: dict, contexts: Mapping[str, Mapping]) -> Iterator[tuple]:
    said = document.get("@context")
    context = Context(contexts.get(said) if isinstance(said, str) else said)
    graph = document.get("@id")
    entities = document["@graph"] if "@graph" in document else [document]
    for entity in entities:
        name = context.expanded(entity["@id"])
        for kind in [entity["@type"]] if isinstance(entity.get("@type"), str) else entity.get("@type", ()):
            yield graph, name, V.RDF_TYPE, context.expanded(kind), "uri", None, None
        for key, values in entity.items():
            if key.startswith("@"):
                continue
            predicate, coerced = context.expanded(key), context.types.get(key)
            for value in values if isinstance(values, list) else [values]:
                if not isinstance(value, dict):
                    text = value if isinstance(value, str) else json.dumps(value)
                    value = {"@id": text} if coerced == "@id" else {"@value": text, "@type": coerced}
                if "@id" in value:
                    o = context.expanded(value["@id"])
                    yield graph, name, predicate, o, "blank" if o.startswith("_:") else "uri", None, None
                else:
                    kind = value.get("@type")
                    yield graph, name, predicate, value["@value"], "literal", kind and context.expanded(kind), value.get("@language")


def document_quads(content: str, contexts: Mapping[str, Mapping] | None = None) -> list[tuple]:
    """The quads of a file of documents; contexts: those that documents name instead of holding them."""
    found = json.loads(content)
    return [q for document in (found if isinstance(found, list) else [found]) for q in _document_quads(document, contexts or {})]


def parsed_documents(files: DataFrame, contexts: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Quads of files (content: text); a file is as large as its writer lets it become."""
    names = [c.split()[0] for c in QUADS.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(document_quads(content, contexts), columns=names)

    return files.select("content").mapInPandas(parse, QUADS)


def _roots(spark: SparkSession, path: str) -> list[str]:
    """The path, and folders of prefixes in it whose names Spark's readers would pass over."""
    hidden = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*/_*")
    found = hidden.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hidden)
    return [path, *(status.getPath().toString() for status in found or ())]


def read_jsonld(spark: SparkSession, path: str, contexts: Mapping[str, Mapping] | None = None, provenance: bool = False) -> DataFrame:
    """Quads of a JSON-LD file, zipped or not, or of all in a directory; those below ``prov`` only if asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonld,zip}").load(_roots(spark, path))
    chosen = found.where(F.col("path").contains("/prov/") if provenance else ~F.col("path").contains("/prov/")) if not path.endswith((".json", ".jsonld", ".zip")) else found

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame({"content": [member_text(content, name)]})

    return parsed_documents(chosen.select("path", "content").mapInPandas(opened, "content string"), contexts)
