"""Where graphs and their provenance are saved: one file each, or a layout of files by kind, prefix and number."""

from __future__ import annotations

import dataclasses
import os
import posixpath
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.text import bucket
from citeweave.graph import Graph
from citeweave.operators.provenance import continued
from citeweave.sources.counters import StoredCounters
from citeweave.sources.jsonld import QUADS, document_head, entity_documents, parsed_documents
from citeweave.sources.members import read_members, write_members
from citeweave.sources.ntriples import line_column, parsed_lines, triples_of
from citeweave.staging import staged

#: Formats of files and what these are called by: a graph's, and its provenance's.
FILES = {"json-ld": ("json", "json"), "nt": ("nt", "nq"), "nt11": ("nt", "nq"), "nquads": ("nq", "nq")}
#: Formats of Spark's own tables, partitioned by the same buckets.
TABLES = ("json", "parquet")
FORMATS = (*FILES, *TABLES)


def _save_table(df: DataFrame, path: str, output_format: str, compressed: bool, columns: list[str], mode: str = "overwrite", only_touched: bool = False) -> None:
    writer = df.write.mode(mode).partitionBy(*columns) if columns else df.write.mode(mode)
    writer = writer.option("partitionOverwriteMode", "dynamic" if only_touched else "static")
    if output_format == "parquet":
        writer.parquet(path)
    else:
        writer.option("compression", "gzip" if compressed else "none").json(path)


def named_graph(uri: Column) -> Column:
    """The graph an entity is kept in: what comes before its number."""
    return F.regexp_extract(uri, r"^(.*/)[^/]*$", 1)


@dataclasses.dataclass(frozen=True)
class _Storage:
    """What both storages do: rows of files by path, reports, counters.

    context_map holds contexts by their paths, of which context_path names the one to write with. Reporters have a method
    ``add_sentence``. modified_entities are rewritten instead of those a save names. Counters of new identifiers are kept in
    info_dir, or by counter_handler.
    """

    output_format: str = "json-ld"
    zip_output: bool = True
    repok: object | None = None
    reperr: object | None = None
    context_map: Mapping[str, Mapping] | None = None
    context_path: str | None = None
    modified_entities: Iterable[str] | None = None
    supplier_prefix: str = ""
    info_dir: str | None = ""
    wanted_label: bool = True
    counter_handler: object | None = None

    def counters(self, spark: SparkSession):
        """What numbers new identifiers: the handler, else counters kept in info_dir, else None."""
        return self.counter_handler or (StoredCounters(spark, self.info_dir) if self.info_dir else None)

    def _context(self) -> Mapping | None:
        return (self.context_map or {}).get(self.context_path) if self.context_path else None

    def _suffix(self, provenance: bool) -> str:
        return "." + FILES[self.output_format][provenance]

    def _file(self, stem: Column, provenance: bool) -> Column:
        return F.concat(stem, F.lit(".zip" if self.zip_output else self._suffix(provenance)))

    def _rows(self, quads: DataFrame, provenance: bool) -> DataFrame:
        """s, grp, text of the files' rows: documents of entities, or lines."""
        if self.output_format == "json-ld":
            return entity_documents(quads, self._context()).select("s", F.col("g").alias("grp"), "text")
        line = line_column(F.col("g")) if self._suffix(provenance) == ".nq" else line_column()
        return quads.select("s", F.lit("").alias("grp"), line.alias("text"))

    def _write(self, rows: DataFrame, root: str, provenance: bool) -> None:
        head = document_head(self._context(), self.context_path) if self.output_format == "json-ld" else None
        try:
            write_members(rows, root, self.zip_output, self._suffix(provenance), head)
        except Exception as error:
            if self.reperr is not None:
                self.reperr.add_sentence(f"Nothing was stored in {root}: {error}")
            raise
        if self.repok is not None:
            self.repok.add_sentence(f"{'Provenance' if provenance else 'The graph'} was stored in {root}")

    def _stored(self, paths: DataFrame, root: str, provenance: bool) -> DataFrame:
        """The quads that files hold already; paths: path."""
        files = read_members(paths, root)
        if self._suffix(provenance) == ".json":
            return parsed_documents(files, self.context_map)
        return parsed_lines(files.select(F.explode(F.split("content", "\n")).alias("value")))

    def _modified(self, spark: SparkSession, modified: DataFrame | None) -> DataFrame | None:
        if self.modified_entities is None:
            return modified
        return spark.createDataFrame([(u,) for u in sorted(set(self.modified_entities))], "uri string")

    def save_graph(self, graph: Graph) -> None:
        self.save(graph)


@dataclasses.dataclass(frozen=True)
class SingleFileStorage(_Storage):
    """The graph in one file, the provenance in another; a zipped file's name ends in .zip instead of its suffix.

    One task writes a file, entity by entity, as one file is what this storage is for.
    """

    graph_path: str = ""
    provenance_path: str = ""

    def _place(self, path: str) -> tuple[str, str]:
        folder, name = posixpath.split(path)
        return folder or ".", os.path.splitext(name)[0] + ".zip" if self.zip_output else name

    def save(self, graph: Graph, provenance: DataFrame | None = None, modified: DataFrame | None = None) -> None:
        triples = triples_of(graph)
        if self.output_format in TABLES:
            _save_table(triples.coalesce(1), self.graph_path, self.output_format, self.zip_output, [])
            if provenance is not None:
                _save_table(provenance.coalesce(1), self.provenance_path, "json", self.zip_output, [])
            return
        folder, name = self._place(self.graph_path)
        rows = self._rows(triples.withColumn("g", named_graph(F.col("s"))), False)
        self._write(rows.select(F.lit(name).alias("path"), "grp", "text"), folder, False)
        if provenance is not None:
            folder, name = self._place(self.provenance_path)
            stored = self._stored(triples.sparkSession.createDataFrame([(name,)], "path string"), folder, True)
            quads = staged(continued(staged(stored, "stored"), provenance, self.wanted_label), "snapshots")
            self._write(self._rows(quads, True).select(F.lit(name).alias("path"), "grp", "text"), folder, True)


@dataclasses.dataclass(frozen=True)
class DirectoryStorage(_Storage):
    """kind / prefix / directory / file of the number at an entity's uri; its snapshots in ``prov/se`` below that.

    Only the files of modified entities are rewritten when those are given, so deleted entities vanish from files; a file of
    which nothing is left is removed. A uri's own prefix (0, digits but 0, 0) goes before the supplier's. items_per_directory
    0 leaves the directory out; process_id marks the files of one of several processes.
    """

    output_dir: str = ""
    items_per_directory: int = 10_000
    items_per_file: int = 1_000
    process_id: int | str | None = None

    def bucket_columns(self, uri: Column) -> dict[str, Column]:
        """The layout of an entity: .../kind/number; a number's buckets are named by their upper ends, 0 by none."""
        number = F.coalesce(F.regexp_extract(uri, r"/(?:0[1-9]+0)?(\d+)$", 1).try_cast("long"), F.lit(0))
        prefix = F.coalesce(F.nullif(F.regexp_extract(uri, r"/(0[1-9]+0)\d+$", 1), F.lit("")), F.lit(self.supplier_prefix or "_"))
        upper = lambda items: bucket(number, items) if items else F.lit(0).cast("long")
        return {"kind": F.regexp_extract(uri, r"([A-Za-z]+)/[^/]*$", 1), "prefix": prefix, "dir_bucket": upper(self.items_per_directory), "file_bucket": upper(self.items_per_file)}

    def _path(self, uri: Column, provenance: bool) -> Column:
        kind, prefix, directory, file = self.bucket_columns(uri).values()
        parts = [kind, prefix, *([directory.cast("string")] if self.items_per_directory else []), file.cast("string"), *([F.lit("prov"), F.lit("se")] if provenance else [])]
        stem = F.concat_ws("/", *parts)
        return self._file(stem if self.process_id is None else F.concat(stem, F.lit(f"_{self.process_id}")), provenance)

    def save(self, graph: Graph, provenance: DataFrame | None = None, modified: DataFrame | None = None) -> None:
        modified = self._modified(graph.br.sparkSession, modified)
        if self.output_format in TABLES:
            self._save_tables(graph, provenance, modified)
            return
        quads = triples_of(graph).withColumn("g", named_graph(F.col("s")))
        touched = None
        if modified is not None:
            touched = staged(modified.select(self._path(F.col("uri"), False).alias("path")).distinct(), "touched")
            quads = quads.withColumn("path", self._path(F.col("s"), False)).join(touched, "path", "left_semi").select(*[c.split()[0] for c in QUADS.split(", ")])
        rows = self._rows(quads, False).select(self._path(F.col("s"), False).alias("path"), "grp", "text")
        if touched is not None:
            rows = rows.unionByName(touched.select("path", F.lit("").alias("grp"), F.lit(None).cast("string").alias("text")))
        self._write(rows, self.output_dir, False)
        if provenance is not None:
            changes = provenance.withColumn("path", self._path(F.col("entity"), True))
            stored = staged(self._stored(changes.select("path"), self.output_dir, True), "stored")
            quads = staged(continued(stored, changes.drop("path"), self.wanted_label), "snapshots")
            entity = F.regexp_replace("s", "/prov/se/[0-9]+$", "")
            self._write(self._rows(quads, True).select(self._path(entity, True).alias("path"), "grp", "text"), self.output_dir, True)

    def _save_tables(self, graph: Graph, provenance: DataFrame | None, modified: DataFrame | None) -> None:
        triples = triples_of(graph)
        names = list(self.bucket_columns(F.lit("")))
        placed = triples.withColumns(self.bucket_columns(F.col("s")))
        graph_dir = f"{self.output_dir}graph"
        if modified is not None:
            touched = modified.select("uri").withColumns(self.bucket_columns(F.col("uri"))).select(*names).distinct()
            placed = placed.join(touched, names, "left_semi")
        _save_table(placed.repartition(*names), graph_dir, self.output_format, self.zip_output, names, only_touched=modified is not None)
        if modified is not None:
            self._drop_emptied(touched, placed.select(*names).distinct(), graph_dir, names)
        if provenance is not None:
            _save_table(provenance.withColumns(self.bucket_columns(F.col("entity"))), f"{self.output_dir}prov", "json", self.zip_output, names, "append")

    def _drop_emptied(self, touched: DataFrame, filled: DataFrame, path: str, names: list[str]) -> None:
        """Delete touched buckets in which nothing is left; there are at most as many as buckets that a step touched."""
        spark = touched.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for row in touched.join(filled, names, "left_anti").toLocalIterator():
            folder = jvm.org.apache.hadoop.fs.Path(path + "".join(f"/{n}={row[n]}" for n in names))
            folder.getFileSystem(conf).delete(folder, True)


def _checked_format(output_format: str) -> str:
    if output_format not in FORMATS:
        raise ValueError(f"output_format must be one of {FORMATS}")
    return output_format


def single_file_storage(graph_path: str | os.PathLike, provenance_path: str | os.PathLike, *, output_format: str = "json-ld", zip_output: bool = True, **more) -> SingleFileStorage:
    """more: repok, reperr, context_map, context_path, modified_entities, supplier_prefix, info_dir, wanted_label, counter_handler."""
    return SingleFileStorage(graph_path=os.fspath(graph_path), provenance_path=os.fspath(provenance_path), output_format=_checked_format(output_format), zip_output=zip_output, **more)


def directory_storage(output_dir: str | os.PathLike, *, items_per_directory: int = 10_000, items_per_file: int = 1_000, supplier_prefix: str = "_", output_format: str = "json-ld", zip_output: bool = True, **more) -> DirectoryStorage:
    """more: as for single_file_storage(), and process_id."""
    if not (folder := os.fspath(output_dir)):
        raise ValueError("output_dir must not be empty")
    if items_per_directory < 0 or items_per_file <= 0:
        raise ValueError("items_per_directory must be at least 0 and items_per_file at least 1")
    return DirectoryStorage(
        output_dir=folder if folder.endswith("/") else folder + "/", items_per_directory=items_per_directory, items_per_file=items_per_file,
        supplier_prefix=supplier_prefix, output_format=_checked_format(output_format), zip_output=zip_output, **more,
    )
