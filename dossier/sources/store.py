"""The evidence store: Parquet tables in folders that are only added, and numbered pointers that commit all of them at once.

**Commits.** A change is made against a version, its base. It writes its new rows, and the ids of documents whose older rows are
gone, to folders with a name of their own, and then creates the pointer after the latest, which lists the folders that make up
the tables. A pointer is created whole and only if its number is free (compare and swap), so every version has one parent
and no two writers can take the same place. A writer that finds versions after its base checks them: if one
of them has changed a document that it changes too, or started a table anew that it adds to, it fails with ``Conflict`` and nothing of it is
seen; otherwise it puts its folders on top of the latest version and tries again. A writer that dies leaves folders that no
pointer names; ``vacuum`` removes those that are old enough.

**Reads.** Readers take the latest pointer once, and see one version of every table; rows of documents that a later commit
deleted leave by an anti join until ``optimize`` merges the folders. Each commit writes an index of the files that hold a document or
page (smallest and largest keys, and Bloom filters), so that ``rows_with`` opens few files, and Parquet's own Bloom filters in these.

**Reconciling.** Each commit writes the set of documents that it touched. Documents whose rows have no ledger row can only come
from commits since the last check, so ``reconcile`` reads the sets of these; the marker of what has been checked goes with the next commit.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..operators import postings
from . import keyindex
from .pointers import Pointers

#: Bytes of a file that optimize writes, about.
FILE_BYTES = 256 << 20
DELETES, KEYS, INDEX = "deletes", "keys", "index"
SUMMARY = "summary.json"
#: Tables with rows of documents, which a ledger row must stand for.
EVIDENCE = ("documents", "pages", "chunks", "assets")
#: Fields by which files are found.
KEYED = {"documents": ("doc_id",), "pages": ("doc_id", "page_id"), "screenshots": ("doc_id", "page_id"), "chunks": ("doc_id",), "assets": ("doc_id",), "ledger": ("doc_id",), DELETES: ("doc_id",)}
KEY_SET = "doc_id string, rows boolean, ledger boolean, gone boolean"
#: Folders that a change writes at a time.
WRITERS = 4
#: Tables that commits make by themselves.
OWN = (DELETES, KEYS, INDEX, *postings.SUMS)
SCHEMAS = {**schemas.EVIDENCE, DELETES: "doc_id string", KEYS: KEY_SET, INDEX: keyindex.SCHEMA}


class Conflict(Exception):
    """Another commit has changed, since the base, what this one changes. Start anew from the latest version."""


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Documents with rows in any table but without a ledger row."""
    ids = reduce(DataFrame.union, (tables[n].select("doc_id") for n in EVIDENCE)).distinct()
    return ids.join(tables["ledger"], "doc_id", "left_anti")


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: The folders of each table, each with the number of the version whose deletions it outlives.
    tables: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    #: The key sets that haven't been reconciled; None if all documents must be.
    unchecked: list[tuple[str, int]] | None = field(default_factory=list)
    #: What the commit did: its key set, tables started anew, or merged.
    did: dict = field(default_factory=dict)

    def json(self) -> dict:
        return {"parent": self.number - 1, "tables": self.tables, "unchecked": self.unchecked, "did": self.did}

    @staticmethod
    def of(n: int, content: dict) -> Version:
        pairs = lambda x: [(f, o) for f, o in x]
        return Version(n, {t: pairs(f) for t, f in content["tables"].items()}, None if content["unchecked"] is None else pairs(content["unchecked"]), content["did"])

    def folders(self, name: str) -> list[str]:
        return [f for f, _ in self.tables.get(name, [])]


class Change:
    """Folders that are written against a version and not yet part of the store."""

    def __init__(self, store: Store, base: Version) -> None:
        self.store, self.base, self.folder = store, base, uuid.uuid4().hex
        self.added: list[str] = []
        self.replaces: tuple[str, ...] = ()

    def write(self, new: dict[str, DataFrame], deleted: DataFrame | None = None, replaces: tuple[str, ...] = ()) -> Change:
        store, self.replaces = self.store, replaces
        if deleted is not None:
            new = {**new, DELETES: deleted.select("doc_id").distinct()}
        self._write(new)
        more = self._sums() if {"chunks", DELETES} & {*self.added} else {}
        own = {name: store._parts(name, [(self.folder, 0)]) for name in self.added if name in KEYED}
        if own:
            # from what has been written, of which only the keys are read
            ids = reduce(DataFrame.union, (df.select("doc_id", F.lit(name in EVIDENCE).alias("rows"), F.lit(name == "ledger").alias("ledger"), F.lit(name == DELETES).alias("gone")) for name, df in own.items()))
            more[KEYS] = ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("rows", "ledger", "gone"))).sort("doc_id")
            more[INDEX] = keyindex.build({name: (df, KEYED[name]) for name, df in own.items()}, self.folder)
        self._write(more)
        return self

    def _write(self, tables: dict[str, DataFrame]) -> None:
        """Write folders side by side: most are small, and none needs another."""
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(lambda x: self.store._write(*x, self.folder), tables.items()))
        self.added += tables

    def _sums(self) -> dict[str, DataFrame]:
        """What this change adds to the sums of the corpus, less what the documents that it deletes had."""
        own = lambda name: self.store._parts(name, [(self.folder, 0)] if name in self.added else [])
        sums = {"lengths": postings.lengths(own("chunks")), "frequencies": postings.frequencies(postings.rows_of(own("postings")))}
        if "chunks" in self.replaces:
            self.replaces = (*self.replaces, *sums)
        elif DELETES in self.added:
            old = self.store.rows_of("chunks", own(DELETES), self.base)
            sums["lengths"] = sums["lengths"].union(postings.lengths(old, -1))
            sums["frequencies"] = sums["frequencies"].union(postings.frequencies(postings.term_table(old, "chunk_id", "asset_team"), -1))
        return {name: postings.summed(rows, name) for name, rows in sums.items()}

    def _check(self, latest: Version) -> None:
        """An error if a version after the base has touched what this change touches."""
        sets = []
        for n in range(self.base.number + 1, latest.number + 1):
            content = self.store.pointers.read(n)
            if content is None:
                raise Conflict(f"version {n} has been removed since version {self.base.number} was read")
            did = content["did"]
            if {*did.get("replaces", ()), *self.replaces} & {*did.get("added", ()), *self.added}:
                raise Conflict(f"version {n} or this change starts a table anew to which the other adds")
            if KEYS in did.get("added", ()):
                sets.append((did["folder"], n))
        if sets and KEYS in self.added:
            both = self.store._parts(KEYS, [(self.folder, 0)]).join(self.store._parts(KEYS, sets), "doc_id", "left_semi").select("doc_id").limit(5).collect()
            if both:
                raise Conflict(f"changed by another commit since version {self.base.number}: {sorted(r.doc_id for r in both)}")

    def land(self) -> Version:
        """Make this change part of the store, on top of whatever has landed since its base; Conflict if that isn't possible."""
        checked = self.base.number
        while True:
            latest = self.store.current()
            if latest.number > checked:
                self._check(latest)
                checked = latest.number
            n = latest.number + 1
            tables = dict(latest.tables)
            for name in self.added:
                if name != KEYS:
                    tables[name] = [*([] if name in self.replaces else tables.get(name, [])), (self.folder, n)]
            unchecked = latest.unchecked
            if {"ledger", *EVIDENCE} & {*self.replaces}:
                unchecked = None
            elif self.store._checked is not None:
                unchecked = [x for x in unchecked or [] if x[1] > self.store._checked] if unchecked is not None or self.store._checked >= latest.number else None
            if unchecked is not None and KEYS in self.added:
                unchecked = [*unchecked, (self.folder, n)]
            made = Version(n, tables, unchecked, {"folder": self.folder, "added": self.added, "replaces": list(self.replaces)})
            if self.store.pointers.put(n, made.json()):
                self.store._checked = None
                return made


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.pointers = Pointers(spark, f"{self.root}/versions")
        self.path, self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, self.pointers.fs
        #: The version up to which this writer has reconciled, which goes with its next commit.
        self._checked: int | None = None

    def versions(self) -> list[int]:
        return self.pointers.numbers()

    def current(self) -> Version:
        """The latest version; an empty one before the first commit."""
        for n in reversed(self.versions()):
            if (content := self.pointers.read(n)) is not None:
                return Version.of(n, content)
        return Version()

    # folders

    def _names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def _write(self, name: str, df: DataFrame, folder: str) -> None:
        out = df.select(*StructType.fromDDL(SCHEMAS[name]).names).write.mode("error")
        for column in KEYED.get(name, ()):
            # adaptive: as small as the keys of a row group allow
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option(f"parquet.bloom.filter.candidates.number#{column}", 16)
        out.parquet(f"{self.root}/{name}/v={folder}")

    def _parts(self, name: str, folders: list[tuple[str, int]], files: list[str] | None = None) -> DataFrame:
        """The rows of some folders, or of some of their files (folder/file), with the number ``v`` that goes with the folder."""
        schema = StructType.fromDDL(SCHEMAS[name] + ", v string")
        paths = [f"v={f}" for f, _ in folders] if files is None else files
        if not paths or not folders:
            return self.spark.createDataFrame([], schema).withColumn("v", F.col("v").cast("int"))
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{name}/{p}" for p in paths))
        order = F.create_map(*(F.lit(x) for pair in folders for x in pair))
        return rows.withColumn("v", F.element_at(order, F.col("v")))

    # reading

    def _alive(self, rows: DataFrame, version: Version, first: int, gone: DataFrame | None = None) -> DataFrame:
        """Rows (doc_id, v) that no later commit has deleted. first: the smallest v."""
        if gone is None:
            later = [(f, n) for f, n in version.tables.get(DELETES, []) if n > first]
            if not later:
                return rows
            gone = self._parts(DELETES, later)
        gone = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.max("v").alias("__v"))
        return rows.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("v") < F.col("__v")), "left_anti")

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        """A table of a version (the latest). ``terms`` are the rows of ``postings``; sums that are no document's are as they are."""
        version = self.current() if version is None else version
        if name == "terms":
            return self.term_rows(version).drop("v")
        folders = version.tables.get(name, [])
        rows = self._parts(name, folders)
        if "doc_id" in rows.columns and folders:
            rows = self._alive(rows, version, min(n for _, n in folders))
        return rows.drop("v")

    def term_rows(self, version: Version | None = None) -> DataFrame:
        """(term, chunk_id, doc_id, asset_team, tf, length, v): what the blocks of postings hold."""
        version = self.current() if version is None else version
        folders = version.tables.get("postings", [])
        rows = postings.rows_of(self._parts("postings", folders))
        return self._alive(rows, version, min(n for _, n in folders)) if folders else rows

    def tables(self) -> dict[str, DataFrame]:
        """All tables of the latest version; blocks of postings and deletions with the number ``v`` of their commit, as searches want them."""
        version = self.current()
        return {name: self.table(name, version) for name in (*schemas.EVIDENCE, "terms")} | {name: self._parts(name, version.tables.get(name, [])) for name in ("postings", DELETES)}

    def rows_with(self, name: str, column: str, key: str, version: Version | None = None) -> DataFrame:
        """The rows of a table with a key (see KEYED), from the files that the index names."""
        version = self.current() if version is None else version
        rows = self._found(name, column, key, version)
        folders = dict(version.tables.get(name, []))
        if not folders or not version.tables.get(DELETES):
            return rows.drop("v")
        # a key belongs to few documents, whose deletions are found by the index too
        ids = [key] if column == "doc_id" else [r.doc_id for r in rows.select("doc_id").distinct().collect()]
        gone = reduce(DataFrame.union, (self._found(DELETES, "doc_id", i, version) for i in ids), self._parts(DELETES, []))
        return self._alive(rows, version, min(folders.values()), gone).drop("v")

    def _found(self, name: str, column: str, key: str, version: Version) -> DataFrame:
        folders = version.tables.get(name, [])
        index = self._parts(INDEX, version.tables.get(INDEX, []))
        there = {f for f, _ in folders}
        files = [f"v={r.folder}/{r.file}" for r in keyindex.files_with(index, name, column, key).collect() if r.folder in there]
        return self._parts(name, folders, sorted(files)).where(F.col(column) == key)

    def rows_of(self, name: str, ids: DataFrame, version: Version | None = None) -> DataFrame:
        """The rows of a table of some documents (doc_id), from the files that the index names."""
        version = self.current() if version is None else version
        folders = version.tables.get(name, [])
        index = self._parts(INDEX, version.tables.get(INDEX, []))
        there = {f for f, _ in folders}
        files = [f"v={r.folder}/{r.file}" for r in keyindex.files_with_any(index, name, "doc_id", ids.select(F.col("doc_id").alias("key"))).collect() if r.folder in there]
        rows = self._parts(name, folders, sorted(files)).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return (self._alive(rows, version, min(n for _, n in folders)) if folders else rows).drop("v")

    # changes

    def change(self, base: Version | None = None) -> Change:
        """A change against a version: the latest, or the one that its rows were made from."""
        return Change(self, self.current() if base is None else base)

    def commit(self, new: dict[str, DataFrame], deleted: DataFrame | None = None, replaces: tuple[str, ...] = (), base: Version | None = None) -> Version:
        """Add rows to tables and take out all older rows of the deleted documents (doc_id); tables in ``replaces`` start anew. Conflict if that can't be."""
        return self.change(base).write(new, deleted, replaces).land()

    def replace(self, doc_ids: DataFrame, new: dict[str, DataFrame], base: Version | None = None) -> Version:
        """Delete all rows of these documents and add the new ones, in one version."""
        return self.commit(new, deleted=doc_ids, base=base)

    def orphans(self) -> DataFrame:
        return orphans(self.tables())

    def unchecked_orphans(self, version: Version) -> DataFrame:
        """The orphans that commits since the last check have made. Reads the key sets of these commits; of the ledger, only rows of documents that got rows without one."""
        if version.unchecked is None:
            return orphans({name: self.table(name, version) for name in (*EVIDENCE, "ledger")})
        at = F.struct(F.col("v").alias("v"), "rows", "ledger", "gone")
        each = self._parts(KEYS, version.unchecked).groupBy("doc_id").agg(F.collect_list(at).alias("seen"), F.max(F.when(F.col("gone"), F.col("v"))).alias("wiped"))
        since = F.filter("seen", lambda s: F.col("wiped").isNull() | (s["v"] >= F.col("wiped")))
        left = each.select("doc_id", F.col("wiped").isNotNull().alias("known"), F.exists(since, lambda s: s["rows"]).alias("rows"), F.exists(since, lambda s: s["ledger"]).alias("ledger")).where("rows AND NOT ledger")
        open_ids = left.where("NOT known").select("doc_id")
        older = open_ids.join(self.rows_of("ledger", open_ids, version), "doc_id", "left_anti") if open_ids.limit(1).count() else open_ids
        return left.where("known").select("doc_id").union(older)

    def reconcile(self) -> int:
        """Delete the orphans' rows; their number."""
        version = self.current()
        if version.unchecked == []:
            return 0
        ids = self.unchecked_orphans(version)
        n = ids.count()
        self._checked = version.number
        if n:
            self.replace(ids, {}, base=version)
        return n

    def counts(self) -> DataFrame:
        """The rows of each table; of postings, what is in their blocks (terms)."""
        return reduce(DataFrame.union, (df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in self.tables().items() if name not in (DELETES, "postings", *postings.SUMS)))

    # upkeep

    def _bytes(self, name: str, folders: list[str]) -> int:
        return sum(self.fs.getContentSummary(self.path(f"{self.root}/{name}/v={f}")).getLength() for f in folders)

    def _merged(self, name: str, version: Version, files: int) -> DataFrame:
        """All rows of a table, as they are to be stored."""
        if name == "postings":
            return postings.blocks(self.term_rows(version).drop("v"), files)
        rows = self.table(name, version)
        if name in postings.SUMS:
            return postings.summed(rows, name)
        return rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")

    def optimize(self, names: list[str] | None = None, file_bytes: int = FILE_BYTES) -> Version:
        """Merge the folders of tables into files of about that size, sorted by document; of all tables, this also drops older versions.

        Commits that land meanwhile stay on top of what has been merged; one that has merged or started anew the same tables is a Conflict.
        """
        base, folder = self.current(), uuid.uuid4().hex
        merged = [t for t in names or base.tables if t not in (DELETES, INDEX, KEYS) and base.tables.get(t)]
        for name in merged:
            files = max(1, math.ceil(self._bytes(name, base.folders(name)) / file_bytes))
            self._write(name, self._merged(name, base, files), folder)
        keyed = {name: (self._parts(name, [(folder, 0)]), KEYED[name]) for name in merged if name in KEYED}
        if keyed:
            self._write(INDEX, keyindex.build(keyed, folder), folder)
        all_of_them = names is None
        while True:
            latest = self.current()
            tables = dict(latest.tables)
            for name in merged:
                if base.tables[name] != latest.tables.get(name, [])[: len(base.tables[name])]:
                    raise Conflict(f"{name} has been merged or started anew by another commit")
                tables[name] = [(folder, base.number), *latest.tables[name][len(base.tables[name]) :]]
            if keyed:
                # the index of folders that are gone goes with them
                left = [x for x in latest.tables.get(INDEX, []) if not all_of_them or x[1] > base.number]
                tables[INDEX] = [*left, (folder, base.number)]
            if all_of_them:
                tables[DELETES] = [x for x in latest.tables.get(DELETES, []) if x[1] > base.number]
            made = Version(latest.number + 1, tables, latest.unchecked, {"folder": folder, "added": [], "replaces": []})
            if self.pointers.put(made.number, made.json()):
                break
        if all_of_them:
            for old in self.versions():
                if old < made.number:
                    self.pointers.drop(old)
            gone = {name: {f for f, _ in folders} - set(made.folders(name)) for name, folders in base.tables.items()}
            for name, folders in gone.items():
                for f in folders:
                    self.fs.delete(self.path(f"{self.root}/{name}/v={f}"), True)
        return made

    def vacuum(self, older_than_seconds: float = 7 * 24 * 3600) -> int:
        """Delete folders that no version names, if they haven't changed for so long: what dead writers, lost conflicts and merges left. Their number."""
        named: dict[str, set[str]] = {name: set() for name in SCHEMAS}
        for n in self.versions():
            version = Version.of(n, self.pointers.read(n) or Version().json())
            for name in version.tables:
                named.setdefault(name, set()).update(version.folders(name))
            named[KEYS].update(f for f, _ in version.unchecked or [])
            named[KEYS].update([version.did["folder"]] if "folder" in version.did else [])
        before, n = (time.time() - older_than_seconds) * 1000, 0
        for name, keep in named.items():
            for folder in self._names(name):
                at = self.path(f"{self.root}/{name}/{folder}")
                if folder.removeprefix("v=") not in keep and self.fs.getFileStatus(at).getModificationTime() <= before:
                    n += bool(self.fs.delete(at, True))
        return n

    def publish(self, dest: str, stamp: str) -> dict:
        """Write the latest version, without deleted rows, to dest/stamp with a summary beside it; an empty store is an error."""
        version = self.current()
        if not version.number:
            raise ValueError("the store is empty: nothing to publish")
        there = Store(self.spark, f"{dest}/{stamp}")
        there.commit({name: self._merged(name, version, max(1, math.ceil(self._bytes(name, version.folders(name)) / FILE_BYTES))) for name in version.tables if name not in OWN})
        summary = {"stamp": stamp, "rows": {r.table: r.n for r in there.counts().collect()}}
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there.root)
        sums = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
        summary |= {"files": sums.files, "bytes": sums.bytes}
        out = self.fs.create(self.path(f"{there.root}/{SUMMARY}"), False)
        out.write(bytearray(json.dumps(summary).encode()))
        out.close()
        return summary

    @staticmethod
    def summary(spark: SparkSession, source: str, stamp: str) -> dict:
        """What publish wrote beside a snapshot."""
        return json.loads(spark.read.text(f"{source}/{stamp}/{SUMMARY}", wholetext=True).first().value)

    @staticmethod
    def restore(spark: SparkSession, source: str, stamp: str, root: str) -> Store:
        """A store at a new root with the rows of a published version; an unknown stamp is an error."""
        there = Store(spark, f"{source}/{stamp}")
        if not there.versions():
            raise ValueError(f"no snapshot {stamp!r}")
        store = Store(spark, root)
        version = there.current()
        store.commit({name: there._parts(name, version.tables[name]).drop("v") for name in version.tables if name not in OWN})
        return store
