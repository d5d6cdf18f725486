"""Catalogue lookups: requests go out as rows (source, op, key) and answers come back as rows with a JSON body."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import quote, urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.text import ascii_fold, author_score, clean_title, indel_ratio, strip_prefix, year_int, year_score
from citeweave.staging import staged

#: Fixed values of the lookups: attempts, first wait in seconds, answers worth another attempt, candidates and their threshold.
ATTEMPTS, FIRST_WAIT, RETRIED, CANDIDATES, TITLE_THRESHOLD = 3, 1.0, (429, 500, 502, 503, 504), 4, 0.8
ANSWERS = "source string, op string, key string, body string"
KEPT = f"{ANSWERS}, time timestamp"
#: Seconds that a catalogue may take, and the properties by which one finds an identifier.
TIMEOUTS = {"crossref": 30.0, "orcid": 30.0, "viaf": 60.0, "wikidata": 60.0, "openalex": 60.0}
WIKIDATA_PROPERTIES = {"doi": "P356", "issn": "P236", "orcid": "P496", "viaf": "P214", "pmid": "P698", "pmcid": "P932"}
OPENALEX_SCHEMES = ("doi", "issn", "pmid", "pmcid")


class LookupProvider(Protocol):
    def answers(self, requests: DataFrame) -> DataFrame:
        """source, op, key, body for the distinct requests (source, op, key) that have an answer."""


class TableLookups:
    """Answers from a table (source, op, key, body), for instance those kept of earlier runs.

    The table is read at the first request, and written as one row a key, so that rounds of requests don't make it anew.
    """

    def __init__(self, table: DataFrame):
        self.table = table
        self._kept: DataFrame | None = None

    def answers(self, requests: DataFrame) -> DataFrame:
        if self._kept is None:
            self._kept = staged(self.table.where("body is not null").groupBy("source", "op", "key").agg(F.min("body").alias("body")), "table")
        asked = requests.select("source", "op", "key").where("key is not null").distinct()
        return asked.join(self._kept, ["source", "op", "key"])


class KeptLookups:
    """Another provider's answers, kept in a table in the shared folder of ``path``: what it holds isn't asked again.

    A request without an answer is kept too, with a null body, and asked again once it is older than ``expiry`` seconds;
    answers are as well if ``answers_expire``. Runs append rows, and of a key's rows the newest counts, an answer before
    none at one time, so runs at once don't disturb each other; compact() leaves one row a key.
    """

    def __init__(self, provider: LookupProvider, path: str, expiry: float = 30 * 86_400.0, answers_expire: bool = False):
        self.provider, self.path, self.expiry, self.answers_expire = provider, path, expiry, answers_expire

    def _table(self, spark: SparkSession) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        held = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return spark.read.schema(KEPT).parquet(self.path) if held else spark.createDataFrame([], KEPT)

    @staticmethod
    def newest(table: DataFrame) -> DataFrame:
        """source, op, key, body, time: of each key the newest row, an answer before none, then the smaller answer."""
        order = F.struct((-F.unix_micros("time")).alias("age"), F.col("body").isNull().alias("none"), "body")
        return table.groupBy("source", "op", "key").agg(F.min(order).alias("o"), F.max("time").alias("time")).select("source", "op", "key", F.col("o.body").alias("body"), "time")

    def _known(self, spark: SparkSession) -> DataFrame:
        """The newest rows that haven't expired; the clock is the driver's."""
        since = F.timestamp_micros(F.lit(int((time.time() - self.expiry) * 1e6)))
        lasting = F.col("time") > since
        return self.newest(self._table(spark)).where(lasting if self.answers_expire else lasting | F.col("body").isNotNull())

    def answers(self, requests: DataFrame) -> DataFrame:
        key = ["source", "op", "key"]
        asked = staged(requests.select(key).where("key is not null").distinct(), "asked")
        known = staged(asked.join(self._known(requests.sparkSession), key).select(*key, "body"), "known")
        open_ = staged(asked.join(known, key, "left_anti"), "open")
        fresh = staged(open_.join(self.provider.answers(open_).select(*key, "body"), key, "left").groupBy(*key).agg(F.min("body").alias("body")), "fresh")
        now = F.timestamp_micros(F.lit(int(time.time() * 1e6)))
        fresh.withColumn("time", now).write.mode("append").parquet(self.path)
        return known.unionByName(fresh).where("body is not null")

    def compact(self, spark: SparkSession) -> None:
        """Rewrite the table with the newest row of each key. No run may append meanwhile: its rows could be lost."""
        table = staged(self.newest(self._table(spark)), "kept")
        table.write.mode("overwrite").parquet(self.path)


#: Where catalogues answer, and how they are asked, by source and op.
def catalogue_url(source: str, op: str, key: str) -> str | None:
    """Where a catalogue answers a request; names, titles and queries are percent encoded as its interface asks for.

    None for identifiers of schemes that the catalogue doesn't know.
    """
    if source == "crossref":
        return "https://api.crossref.org/" + {"journal": f"journals/{key}", "member": f"works/{key}", "works": f"works?{key}"}[op]
    if source == "orcid":
        return f"https://pub.orcid.org/v2.1/search?q={quote(key)}" if op == "search" else f"https://pub.orcid.org/v2.1/{key.upper()}/personal-details"
    if source == "viaf":
        asked = json.loads(key)
        return f'http://www.viaf.org/viaf/search?local.title+all+"{quote(asked["title"])}"&query=local.names+all+"{quote(asked["name"])}"&sortKeys=holdingscount&recordSchema=BriefVIAF'
    scheme, literal = key.split(":", 1)
    if source == "wikidata":
        if (prop := WIKIDATA_PROPERTIES.get(scheme)) is None:
            return None
        return "https://query.wikidata.org/sparql?" + urlencode({"format": "json", "query": f'SELECT ?item WHERE {{ ?item p:{prop} ?x. ?x ps:{prop} "{literal}". }} LIMIT 1'})
    if source == "openalex":
        return None if scheme not in OPENALEX_SCHEMES else f"https://api.openalex.org/{'sources' if scheme == 'issn' else 'works'}?filter={scheme}:{literal}&select=id"
    raise ValueError(f"no catalogue {source}")


def fetch(url: str, timeout: float, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT) -> str | None:
    """A response's text. Failed requests and the statuses RETRIED are tried again, after waits that double; others aren't."""
    seen: list[int | None] = []
    request = urllib.request.Request(url.replace(" ", "%20"), headers={"Accept": "application/json", "User-Agent": "citeweave"})
    while len(seen) < attempts:
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                if response.status == 200:
                    return response.read().decode()
                seen.append(response.status)
        except urllib.error.HTTPError as error:
            seen.append(error.code)
        except OSError:
            seen.append(None)
        if seen[-1] is not None and seen[-1] not in RETRIED:
            return None
        if len(seen) < attempts:
            time.sleep(wait * 2 ** (len(seen) - 1))
    return None


class HttpLookups:
    """Answers over HTTP, each distinct request once; url_of: (source, op, key) -> url, or None for no answer.

    Requests run in ``partitions`` tasks at most, as many as the catalogues bear at once, each ``pause`` seconds apart.
    """

    def __init__(self, url_of: Callable[[str, str, str], str | None] = catalogue_url, timeouts: dict[str, float] | None = None, partitions: int = 8, pause: float = 0.0):
        self.url_of, self.timeouts, self.partitions, self.pause = url_of, TIMEOUTS if timeouts is None else timeouts, partitions, pause

    def answers(self, requests: DataFrame) -> DataFrame:
        url_of, timeouts, pause = self.url_of, self.timeouts, self.pause

        def one(source: str, op: str, key: str) -> str | None:
            if (url := url_of(source, op, key)) is None:
                return None
            time.sleep(pause)
            return fetch(url, timeouts.get(source, 30.0))

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                bodies = [one(*row) for row in frame[["source", "op", "key"]].itertuples(index=False)]
                yield frame.assign(body=bodies).dropna(subset=["body"])

        asked = requests.select("source", "op", "key").where("key is not null").distinct()
        return asked.repartition(self.partitions).mapInPandas(ask, ANSWERS)


def lookup(provider: LookupProvider, requests: DataFrame, source: str, op: str) -> DataFrame:
    """The requests (with a column key) that have an answer, with its body; keys are asked once however many ask them."""
    named = requests.withColumns({"source": F.lit(source), "op": F.lit(op)})
    return named.join(provider.answers(named), ["source", "op", "key"]).drop("source", "op")


def load_stop_words(spark: SparkSession, path: str) -> list[str]:
    """The words of a text file, one to a line, without repetitions; for title searches."""
    return sorted({r.value.strip() for r in spark.read.text(path).collect()} - {""})


def viaf_key(given: Column, family: Column, title: Column) -> Column:
    """A search for a title and a name, as two fields."""
    name = F.trim(F.concat_ws(" ", F.coalesce(given, F.lit("")), F.coalesce(family, F.lit(""))))
    return F.to_json(F.struct(F.coalesce(title, F.lit("")).alias("title"), name.alias("name")))


def viaf_id(body: Column) -> Column:
    """The identifier, only if there is exactly one record."""
    record = F.from_json(body, "searchRetrieveResponse struct<numberOfRecords:struct<content:string>,records:string>")["searchRetrieveResponse"]
    found = F.get_json_object(record["records"], "$.record.recordData['v:VIAFCluster']['v:viafID'].content")
    return F.when(record["numberOfRecords"]["content"].try_cast("int") == 1, found)


def wikidata_id(body: Column) -> Column:
    """The last path segment of the first binding."""
    first = F.get_json_object(body, "$.results.bindings[0].item.value")
    return F.element_at(F.split(first, "/"), -1)


def wikidata_key(scheme: Column, literal: Column) -> Column:
    """DOIs are asked in upper case."""
    return F.concat_ws(":", scheme, F.when(scheme == "doi", F.upper(literal)).otherwise(literal))


def crossref_issns(body: Column, asked: Column) -> Column:
    """A journal's other ISSNs: the list without the first occurrence of the one asked."""
    listed = F.from_json(body, "message struct<ISSN:array<string>>")["message"]["ISSN"]
    at = F.array_position(listed, asked).cast("int")
    return F.when(at > 0, F.concat(F.slice(listed, F.lit(1), at - 1), F.slice(listed, at + 1, F.size(listed)))).otherwise(listed)


def crossref_member(body: Column) -> Column:
    return F.get_json_object(body, "$.message.member")


def openalex_ids(body: Column) -> Column:
    results = F.from_json(body, "results array<struct<id:string>>")["results"]
    return F.transform(F.filter(results, lambda r: r["id"].isNotNull()), lambda r: strip_prefix(r["id"]))


def crossref_key(title: Column, stop_words: list[str]) -> Column:
    """A bibliographic search by the title's first telling words."""
    return F.concat(F.lit("query.bibliographic="), clean_title(ascii_fold(title), stop_words), F.lit(f"&rows={CANDIDATES}&select=DOI,title,author,issued"))


def best_candidate(scored: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """query, doi, title_score, author_score, year_score of the best candidate over the threshold.

    scored: query, pos, doi, title_score, author_score, year_score, has_author. Title decides, then authors, then year, then
    the later position; a query with authors needs a point for them. The best one alone is judged.
    """
    order = F.struct("title_score", "author_score", "year_score", "pos")
    best = scored.groupBy("query").agg(F.max(order).alias("o"), F.max_by("doi", order).alias("doi"), F.max("has_author").alias("has_author"))
    good = (F.col("o.title_score") > threshold) & (~F.col("has_author") | (F.col("o.author_score") >= 1)) & F.col("doi").isNotNull()
    return best.where(good).select("query", "doi", F.col("o.title_score").alias("title_score"), F.col("o.author_score").alias("author_score"), F.col("o.year_score").alias("year_score"))


def crossref_doi(answers: DataFrame) -> DataFrame:
    """query, doi for answers (query, title, year, given, family, body); the title is compared as it is written."""
    item = "struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>"
    parsed = answers.withColumn("items", F.from_json("body", f"message struct<items:array<{item}>>")["message"]["items"])
    rows = parsed.select("query", "title", "year", "given", "family", F.posexplode(F.slice("items", 1, CANDIDATES)).alias("pos", "item"))
    issued = F.get(F.get(F.col("item.issued.date-parts"), F.lit(0)), F.lit(0))
    found = F.lower(F.get(F.col("item.title"), F.lit(0)))
    has_author = F.coalesce(F.col("given") != "", F.lit(False)) | F.coalesce(F.col("family") != "", F.lit(False))
    scored = rows.select(
        "query", "pos", F.col("item.DOI").alias("doi"),
        F.coalesce(indel_ratio(F.col("title"), found), F.lit(0.0)).alias("title_score"),
        F.when(has_author, F.coalesce(author_score(F.coalesce("given", F.lit("")), F.coalesce("family", F.lit("")), F.col("item.author")), F.lit(0))).otherwise(0).alias("author_score"),
        F.coalesce(year_score(year_int(F.col("year")), issued), F.lit(0)).alias("year_score"), has_author.alias("has_author"),
    )
    return best_candidate(scored).select("query", "doi")


def orcid_matches(hits: DataFrame, authors: DataFrame) -> DataFrame:
    """agent, orcid: the first hit of a search whose details contain the author's names.

    hits: query, pos, orcid, given, family; authors: query, agent, given, family; an author without a family name
    matches none.
    """
    met = authors.where("family is not null").join(hits.select("query", "pos", "orcid", F.col("given").alias("g"), F.col("family").alias("f")), "query")
    fits = F.lower("f").contains(F.lower("family")) & (F.col("given").isNull() | F.lower("g").contains(F.lower("given")))
    return met.where(fits).groupBy("query", "agent").agg(F.upper(F.min_by("orcid", "pos")).alias("orcid"))
