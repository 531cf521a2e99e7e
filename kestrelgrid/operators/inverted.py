"""A versioned inverted keyword index of a table of files: it outlives the session and is kept up file by file.

Folder of an index::

    postings/generation=G   (file, kw, entity, weight) in ranges of kw, sorted: what searches read
    forward/generation=G    (file, entity, kw, weight) in order of file: what a changed file held before
    tables/NAME             terms (kw, df, zipf), sorted by kw, and the manifest (path, length, modified, generation, file) of a version
    log/N.json              names of these, written last, by a rename: version N exists once it is there

A refresh lists the files that Spark reads (path, length and time, by Spark's own
listing, also below partition folders) and compares them with the manifest. Only
new and changed files are read; they become a new generation. Postings of files
that the manifest no longer names in their generation are dead and masked. The
document frequencies change by the pairs (keyword, entity) that come and go; an
entity whose rows lie in several files keeps a pair as long as one of them has it.
Generations beyond MOST_GENERATIONS are merged into one. Readers stay on the
version that they opened; writers never share a name, and of two that make the
same version the second fails.

``definition`` names what keywords are; an index of another definition is made anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S

#: Generations of postings that a search opens at most; beyond them a refresh merges all.
MOST_GENERATIONS = 8
#: Changed files that are read by name; beyond them the whole table is read and joined with their list.
MOST_NAMED = 1_000

_POSTINGS = "file long, kw string, entity long, weight double, generation long"
_FORWARD = "file long, entity long, kw string, weight double, generation long"
_TERMS = "kw string, df long, zipf double"
_FILES = "path string, length long, modified timestamp, generation long, file long"


@dataclass(frozen=True)
class Inverted:
    """One version: postings(kw, entity, weight) and terms(kw, df, zipf)."""

    postings: DataFrame
    terms: DataFrame

    def of_words(self, words: list[str]) -> DataFrame:
        """(kw, entity, weight, df, zipf) of a few keywords; the filter reaches both scans."""
        return self.postings.where(F.col("kw").isin(words)).join(F.broadcast(self.terms.where(F.col("kw").isin(words))), "kw")

    def of_patterns(self, either) -> DataFrame:
        """As ``of_words`` for the keywords on which the predicate on ``kw`` holds; it reaches both scans, so only what it finds is joined."""
        return self.postings.where(either).join(self.terms.where(either), "kw")


class ConflictError(RuntimeError):
    """Another writer made the same version first."""


class KeywordIndex:
    """The index in ``folder`` of a table of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str, definition: str = ""):
        self.spark, self.folder, self.definition = spark, folder.rstrip("/"), definition
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions

    def versions(self) -> list[int]:
        log = self._path(f"{self.folder}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/log/{version}.json"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _commit(self, version: int, entry: dict) -> None:
        final, draft = self._path(f"{self.folder}/log/{version}.json"), self._path(f"{self.folder}/log/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.writeUTF(json.dumps(entry))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConflictError(f"version {version} of {self.folder} was made by another writer")

    def read(self, version: int | None = None) -> Inverted:
        """A version (the newest), as it was committed."""
        entry = self._entry(self.versions()[-1] if version is None else version)
        live = self._live("postings", _POSTINGS, entry).select("kw", "entity", "weight")
        if entry["shared"]:
            live = live.groupBy("kw", "entity").agg(F.sum("weight").alias("weight"))
        return Inverted(live, self._table(entry["terms"], _TERMS))

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/tables/{name}")

    def _put(self, rows: DataFrame, schema: str) -> tuple[str, DataFrame]:
        """The rows as a table of a new name."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/tables/{name}")
        return name, self._table(name, schema)

    def _drop(self, path: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{path}"), True)

    def _generations(self, kind: str, schema: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{kind}/generation={g}" for g in numbers])

    def _live(self, kind: str, schema: str, entry: dict) -> DataFrame:
        """Rows of the generations of a version without those of files that were replaced."""
        if not entry["generations"]:
            return self.spark.createDataFrame([], schema)
        rows = self._generations(kind, schema, entry["generations"])
        return rows.join(self._table(entry["manifest"], _FILES).select("generation", "file"), ["generation", "file"], "left_semi") if entry["dead"] else rows

    # --- refresh

    def listing(self, table: str) -> DataFrame:
        """(path, length, modified) of the files that Spark reads for a table; no content is read."""
        files = self.spark.read.format("binaryFile").load(table)
        return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"))

    def refresh(self, table: str, keywords: Callable[[DataFrame], DataFrame], entity: str | None = None) -> Inverted:
        """The newest version, after what changed in ``table`` is taken in.

        ``keywords``: rows of the table with a column ``file`` -> (file, entity, kw,
        weight), one row for each occurrence or count. ``entity``: the column with
        the entity, if ``keywords`` gives each keyword of a row once; where no entity
        has two rows in a file nothing is left to add up, and no word shuffles for it.
        """
        versions = self.versions()
        entry = self._entry(versions[-1]) if versions else None
        if entry is None or entry["definition"] != self.definition:
            entry = {"generations": [], "dead": 0, "shared": False}
        known = self._table(entry["manifest"], _FILES) if "manifest" in entry else self.spark.createDataFrame([], _FILES)
        both = self.listing(table).alias("new").join(known.alias("old"), F.col("new.path") == F.col("old.path"), "full_outer")
        same = F.coalesce((F.col("new.length") == F.col("old.length")) & (F.col("new.modified") == F.col("old.modified")), F.lit(False))
        status = F.when(same, "same").when(F.col("new.path").isNull(), "gone").when(F.col("old.path").isNull(), "new").otherwise("changed")
        state = both.select(F.coalesce("new.path", "old.path").alias("path"), "new.length", "new.modified", "old.generation", "old.file", status.alias("status"))
        if "manifest" in entry and state.where("status <> 'same'").isEmpty():
            return self.read(versions[-1])
        return self._update(table, keywords, entity, state, entry, (versions or [0])[-1] + 1)

    def _update(self, table: str, keywords, entity: str | None, state: DataFrame, entry: dict, version: int) -> Inverted:
        # written once, so that a file that changes meanwhile is of one state in all that follows
        draft, state = self._put(state, _FILES + ", status string")
        counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}
        added, lost = counts.get("new", 0) + counts.get("changed", 0), counts.get("gone", 0) + counts.get("changed", 0)
        number = _number()
        fresh = state.where("status in ('new', 'changed')").coalesce(1).select("path", "length", "modified", F.lit(number).alias("generation"), F.monotonically_increasing_id().alias("file"))
        same = state.where("status = 'same'").select("path", "length", "modified", "generation", "file")
        now = dict(entry)
        now["manifest"], files = self._put(same.unionByName(fresh), _FILES)
        new_pairs = old_pairs = None
        if added:
            self._write_generation(*self._words(table, keywords, entity, files.where(F.col("generation") == number), added), number)
            now["generations"] = [*entry["generations"], number]
            new_pairs = self._generations("forward", _FORWARD, [number])
        if lost:
            replaced = state.where("status in ('gone', 'changed')").select("generation", "file")
            old_pairs = self._generations("forward", _FORWARD, entry["generations"]).join(F.broadcast(replaced) if lost <= MOST_NAMED else replaced, ["generation", "file"], "left_semi")
        terms, shared = self._delta(new_pairs, number, added, old_pairs, entry, same)
        if "terms" in entry:
            terms = self._table(entry["terms"], _TERMS).select("kw", "df").unionByName(terms).groupBy("kw").agg(F.sum("df").alias("df"))
        counted, terms = self._put(terms.where("df > 0"), "kw string, df long")
        now["terms"], _ = self._put(S.zipf(terms).select("kw", "df", "zipf").repartitionByRange("kw").sortWithinPartitions("kw"), _TERMS)
        now |= {"dead": entry["dead"] + lost, "shared": entry["shared"] or shared, "definition": self.definition, "added": added, "lost": lost}
        if len(now["generations"]) > MOST_GENERATIONS:
            now |= self._merged(now)
        self._commit(version, now)
        self._drop(f"tables/{draft}")
        self._drop(f"tables/{counted}")
        return self.read(version)

    def _words(self, table: str, keywords, entity: str | None, fresh: DataFrame, n: int) -> tuple[DataFrame, bool]:
        """(file, kw, entity, weight) of the new files, and whether they come file by file; only these are read."""
        read = self.spark.read
        if n <= MOST_NAMED:
            # a path of the metadata is a URI
            uri = self.spark.sparkContext._jvm.java.net.URI
            names = [self._path(uri(r["path"])).toString() for r in fresh.select("path").collect()]
            rows = read.option("basePath", table).parquet(*names) if self._is_folder(table) else read.parquet(*names)
            listed = F.broadcast(fresh.select(F.col("path").alias("_path"), F.col("file").alias("_file")))
        else:
            rows, listed = read.parquet(table), fresh.select(F.col("path").alias("_path"), F.col("file").alias("_file"))
        rows = rows.withColumn("_path", F.col("_metadata.file_path")).join(listed, "_path").drop("_path", "file").withColumnRenamed("_file", "file")
        if entity and rows.groupBy("file", entity).count().where("count > 1").isEmpty():
            return keywords(rows), n <= MOST_NAMED
        return keywords(rows).groupBy("file", "entity", "kw").agg(F.sum("weight").alias("weight")), False

    def _is_folder(self, table: str) -> bool:
        path = self._path(table)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()

    def _write_generation(self, rows: DataFrame, by_file: bool, number: int) -> None:
        """The rows by file, and from there as postings by keyword; rows that come file by file are written as they come."""
        rows, draft = rows.select("file", "entity", "kw", "weight"), None
        if not by_file:
            # ranges are found in a pass of their own: the rows are made once
            draft, rows = self._put(rows, _FORWARD.replace(", generation long", ""))
            rows = rows.repartitionByRange("file", "entity").sortWithinPartitions("file", "entity")
        rows.write.parquet(f"{self.folder}/forward/generation={number}")
        if draft:
            self._drop(f"tables/{draft}")
        written = self._generations("forward", _FORWARD, [number]).select("file", "kw", "entity", "weight")
        written.repartitionByRange("kw", "entity").sortWithinPartitions("kw", "entity").write.parquet(f"{self.folder}/postings/generation={number}")

    def _delta(self, new: DataFrame | None, number: int, added: int, old: DataFrame | None, entry: dict, same: DataFrame) -> tuple[DataFrame, bool]:
        """(kw, df): how document frequencies change, and whether an entity has rows in more files than one."""
        # a file has a pair once, so pairs repeat only where an entity lies in several files
        shared = added > 1 and not new.select("entity", "file").distinct().groupBy("entity").count().where("count > 1").isEmpty()
        # in order of the keyword each task counts its own keywords
        counted = None if new is None else self._generations("postings", _POSTINGS, [number])
        sides = [(x.select("entity", "kw", F.lit(by).alias("by")), again) for x, by, again in ((counted, 1, shared), (old, -1, entry["shared"])) if x is not None]
        sides = [x.distinct() if again else x for x, again in sides]
        if not sides:
            return self.spark.createDataFrame([], "kw string, df long"), False
        pairs = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        if entry["generations"]:
            kept = self._generations("forward", _FORWARD, entry["generations"]).join(same.select("generation", "file"), ["generation", "file"], "left_semi")
            # entities of the pairs that unchanged files hold, too: what those hold neither comes nor goes
            also = kept.select("entity").join(pairs.select("entity").distinct(), "entity", "left_semi")
            if not also.isEmpty():
                shared = True
                pairs = pairs.join(kept.select("entity", "kw").distinct(), ["entity", "kw"], "left_anti")
        return pairs.groupBy("kw").agg(F.sum("by").alias("df")), shared

    def _merged(self, now: dict) -> dict:
        """All live postings as one generation, under new numbers of the files."""
        number = _number()
        draft, numbered = self._put(self._table(now["manifest"], _FILES).coalesce(1).withColumn("number", F.monotonically_increasing_id()), _FILES + ", number long")
        rows = self._live("postings", _POSTINGS, now).join(numbered.select("generation", "file", "number"), ["generation", "file"])
        self._write_generation(rows.select(F.col("number").alias("file"), "kw", "entity", "weight"), False, number)
        manifest, _ = self._put(numbered.select("path", "length", "modified", F.lit(number).alias("generation"), F.col("number").alias("file")), _FILES)
        self._drop(f"tables/{draft}")
        return {"generations": [number], "manifest": manifest, "dead": 0}

    def vacuum(self, keep: int = 1) -> None:
        """Delete what no version of the newest ``keep`` names; for when no other is read or written any more."""
        versions = self.versions()
        entries = [self._entry(v) for v in versions[-keep:]]
        used = {f"generation={g}" for e in entries for g in e["generations"]} | {e[k] for e in entries for k in ("terms", "manifest")}
        for v in versions[:-keep]:
            self._drop(f"log/{v}.json")
        for kind in ("postings", "forward", "tables"):
            folder = self._path(f"{self.folder}/{kind}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if (name := s.getPath().getName()) not in used:
                    self._drop(f"{kind}/{name}")


def _number() -> int:
    """A number of a generation that no other writer has."""
    return uuid.uuid4().int >> 66
