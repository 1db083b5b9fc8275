"""Table commands as SQL text. A statement that is none of them goes to Spark, with search operators rewritten.

Names after the keywords may be quoted paths or paths of registered tables. Conditions are conjunctions of comparisons.
"""

from __future__ import annotations

import re
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from skyquill.functions.text import parse_size
from skyquill.operators.search import search_sql
from skyquill.sources import companion, maintenance
from skyquill.sources.table import Table

_PATH = r"(?P<path>'[^']+'|`[^`]+`|[\w./:\-]+)"
_WHERE = r"(?:\s+WHERE\s+(?P<where>.+?))?"
_KIND = r"(?:SKYQUILL|TABLE|INDEX|SIDE\s+INDEX)"
_STRING = r"'[^']+'"


def _list(name: str) -> str:
    return rf"\(\s*(?P<{name}>[^)]*)\)"


def _items(text: str | None) -> list[str]:
    return [_unquote(x.strip()) for x in text.split(",") if x.strip()] if text else []


def _pairs(text: str | None) -> dict[str, str]:
    return {_unquote(k): _unquote(v) for k, v in re.findall(r"('[^']+'|\w+)\s*[:=]\s*('[^']+'|\w+)", text or "")}


class CommandError(ValueError):
    """The command cannot be read."""


def _unquote(text: str) -> str:
    return text[1:-1] if text and text[0] in "'`\"" else text


def _value(text: str):
    text = text.strip()
    if text[0] in "'\"":
        return text[1:-1].replace("''", "'")
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)


def conditions(text: str | None) -> list[tuple]:
    """``a = 1 AND b IN ('x', 'y') AND c BETWEEN 1 AND 2 AND d IS NULL`` as triples."""
    if not text:
        return []
    out, text = [], text.strip()
    literal = r"'(?:[^']|'')*'|[+-]?[\d.]+|true|false"
    one = re.compile(
        rf"\s*(?P<c>`[^`]+`|[\w.]+)\s*(?:(?P<op>>=|<=|!=|<>|=|<|>)\s*(?P<v>{literal})|(?P<null>IS\s+(?:NOT\s+)?NULL)|IN\s*\((?P<list>(?:\s*(?:{literal})\s*,?)+)\)|BETWEEN\s+(?P<a>{literal})\s+AND\s+(?P<b>{literal}))\s*(?P<and>AND\b|$)", re.I
    )
    at = 0
    while at < len(text):
        found = one.match(text, at)
        if not found:
            raise CommandError(f"cannot read the condition {text[at:]!r}")
        c = _unquote(found["c"])
        if found["op"]:
            out.append((c, {"<>": "!="}.get(found["op"], found["op"]), _value(found["v"])))
        elif found["null"]:
            out.append((c, "is not null" if "not" in found["null"].lower() else "is null", None))
        elif found["list"]:
            out.append((c, "in", [_value(v) for v in re.findall(literal, found["list"], re.I)]))
        else:
            out += [(c, ">=", _value(found["a"])), (c, "<=", _value(found["b"]))]
        at = found.end()
    return out


class Commands:
    """Runs statements in one session; keeps registered tables, jobs and the profiler's times."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names, self.jobs, self.merges, self.tables = spark, {}, {}, [], {}
        self.profiling, self.profile = False, {}
        self.rules = [(re.compile(rf"\s*{p}\s*;?\s*$", re.I | re.S), f) for p, f in self._rules()]

    def register(self, name: str, path: str, view: bool = True) -> None:
        """A read-only catalog entry: the name in commands, and a view in SQL."""
        self.names[name] = path
        if view:
            Table(self.spark, path).read().createOrReplaceTempView(name)

    def table(self, text: str) -> Table:
        """The table of a path or name; its log, as far as it was read, is kept until INVALIDATE."""
        text = _unquote(text)
        path = self.names.get(text, text)
        if path not in self.tables:
            self.tables[path] = Table(self.spark, path)
        return self.tables[path]

    def rows(self, rows, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def sql(self, statement: str, search_on: DataFrame | None = None, **options) -> DataFrame:
        began = time.time()
        try:
            for pattern, run in self.rules:
                found = pattern.match(statement)
                if found:
                    return run(found.groupdict())
            return search_sql(self.spark, statement, search_on, **options)
        finally:
            if self.profiling:
                key = " ".join(statement.split()[:2]).upper()
                n, s = self.profile.get(key, (0, 0.0))
                self.profile[key] = (n + 1, s + time.time() - began)

    def _rules(self):
        status = "path string, status string, message string"
        ok = lambda path, text="": self.rows([(path, "ok", text)], status)
        number = lambda g, k: int(g[k]) if g.get(k) else None

        def merge(g):
            if not g["path"]:
                raise CommandError("MERGE needs a path or the name of a table")
            t = self.table(g["path"])
            done = maintenance.compact(t, conditions(g["where"]), g["size"] or maintenance.TARGET, number(g, "groups"), number(g, "files"), bool(g["precommit"]))
            self.merges.append((t.path, sum(r["status"] == "merged" for r in done), "planned" if g["precommit"] else "done"))
            return self.rows([(t.path, r["partition"], r["merged"], r["into"], r["bytes"], r["version"], r["status"]) for r in done], "path string, partition string, merged long, into long, bytes long, version long, status string")

        def purge(g):
            return maintenance.purge(self.table(g["path"]), _hours(g["age"], 168.0), bool(g["dry"]), _hours(g["keep"], None))

        def drop(g):
            t = self.table(g["path"])
            before = len(t.snapshot().files)
            version = maintenance.drop_partitions(t, conditions(g["where"]))
            return ok(t.path, f"version {version}, {before - len(t.snapshot().files)} files removed")

        def repair(g):
            return ok(_unquote(g["path"]), f"{maintenance.repair(self.table(g['path']), _unquote(g['target']))} files left out")

        def invalidate(g):
            path = self.table(g["path"]).path if g["path"] else None
            gone = [p for p in list(self.tables) if path is None or p.rstrip("/") == path]
            for p in gone:
                self.tables.pop(p).invalidate()
            return ok(path or "", f"{len(gone)} logs are read again at the next use")

        def flush(g):
            return ok("", f"{maintenance.flush_cache()} tables released")

        def checkpoint(g):
            return ok(_unquote(g["path"]), f"version {self.table(g['path']).checkpoint()}")

        def truncate(g):
            return self.rows([(p, not g["dry"]) for p in maintenance.truncate(self.table(g["path"]), dry_run=bool(g["dry"]))], "file string, deleted boolean")

        def prewarm(g):
            t, columns = self.table(g["path"]), _items(g["fields"]) or None
            if g["segments"]:
                maintenance.segments(_items(g["segments"]))  # all of them are columns' data here
            job = {"id": uuid.uuid4().hex[:8], "path": t.path, "rows": None, "status": "running"}
            self.jobs[job["id"]] = job

            def run():
                try:
                    job.update(rows=maintenance.prewarm(t, columns, conditions(g["where"]), number(g, "parallelism")), status="done")
                except Exception as error:
                    job.update(status=f"failed: {error}")

            job["thread"] = threading.Thread(target=run, daemon=True)
            job["thread"].start()
            if not g["async_"]:
                job["thread"].join()
            return jobs({"id": job["id"]})

        def jobs(g):
            found = [j for j in self.jobs.values() if not g.get("id") or j["id"] == g["id"]]
            return self.rows([(j["id"], j["path"], j["rows"], j["status"]) for j in found], "job string, path string, rows long, status string")

        def wait(g):
            end = time.time() + (number(g, "seconds") or 3600)
            path = self.table(g["path"]).path if g["path"] else None
            wanted = [j for j in self.jobs.values() if (not g["id"] or j["id"] == _unquote(g["id"])) and path in (None, j["path"])]
            for j in wanted:
                j["thread"].join(max(0, end - time.time()))
            return self.rows([(j["id"], j["path"], j["rows"], j["status"]) for j in wanted], "job string, path string, rows long, status string")

        def build(g):
            hashed = (g["hashed_how"].upper(), _items(g["hashed"])) if g["hashed_how"] else None
            plain = {k: _unquote(g[k]) for k in ("catalog", "type", "warehouse", "heap") if g[k]} | ({"fast_fields": g["fast"].upper()} if g["fast"] else {})
            config = {"build": plain, "table_roots": _pairs(g["roots"])}
            reader = {k: v for k, v in (("versionAsOf", g["version"]), ("snapshot-id", g["snapshot"])) if v}
            options = {
                "kind": g["kind"].lower(), "where": g["where"] or g["where2"], "schema_source": _unquote(g["schema"]) if g["schema"] else None, "columns": _items(g["include"]) or None, "exclude": _items(g["exclude"]),
                "hashed": hashed, "target_bytes": parse_size(_unquote(g["size"])) if g["size"] else None, "reader_options": reader, "again": bool(g["all"]), "config": {k: v for k, v in config.items() if v},
            }
            args = (self.spark, _unquote(g["path"]), _unquote(g["index"]), _pairs(g["modes"]))
            dry = bool(g["dry"] or g["dry2"])
            done = companion.sync(*args, dry_run=dry, **options)
            if g["seconds"] and not dry:
                from skyquill.streaming.ingest import poll_sync

                pause = float(g["seconds"]) * (60 if g["unit"].upper().startswith("MINUTE") else 1)
                options["again"] = False
                threading.Thread(target=poll_sync, args=(*args, pause), kwargs=options, daemon=True).start()
            return self.rows([(_unquote(g["index"]), done["added"], done["removed"], done["kept"], done["version"])], "index string, added long, removed long, kept long, version long")

        def root(g):
            t = self.table(g["path"])
            if g["name"]:
                named = dict(t.snapshot().metadata["config"].get("table_roots", {}))
                if g.get("root"):
                    named[_unquote(g["name"])] = _unquote(g["root"])
                elif named.pop(_unquote(g["name"]), None) is None:
                    raise CommandError(f"no table root {g['name']}")
                maintenance.set_config(t, table_roots=named or None)
            else:
                maintenance.set_config(t, table_root=_unquote(g["root"]) if g.get("root") else None)
            return ok(t.path)

        def roots(g):
            config = self.table(g["path"]).snapshot().metadata["config"]
            found = [*config.get("table_roots", {}).items(), *([(None, config["table_root"])] if "table_root" in config else [])]
            return self.rows(found, "root_name string, root_path string")

        def profiler(g):
            word = g["what"].upper()
            if word in ("ENABLE", "DISABLE"):
                self.profiling = word == "ENABLE"
            elif word == "RESET":
                self.profile.clear()
            return self.rows([(k, n, s) for k, (n, s) in self.profile.items()], "statement string, calls long, seconds double")

        def storage(g):
            return self.rows([(p, str(df.storageLevel)) for p, df in maintenance._prewarmed.items()], "path string, level string")

        return [
            (rf"MERGE\s+(?:FILES|SPLITS)(?:\s+(?:IN\s+)?(?!(?:WHERE|TARGET|MAX|PRECOMMIT)\b){_PATH})?{_WHERE}(?:\s+TARGET\s+SIZE\s+(?P<size>\w+|{_STRING}))?(?:\s+MAX\s+(?:GROUPS|DEST\s+SPLITS)\s+(?P<groups>\d+))?(?:\s+MAX\s+SOURCE\s+(?:FILES|SPLITS)(?:\s+PER\s+MERGE)?\s+(?P<files>\d+))?(?P<precommit>\s+PRECOMMIT)?", merge),
            (rf"PURGE\s+{_KIND}\s+{_PATH}(?:\s+OLDER\s+THAN\s+(?P<age>\d+\s+\w+))?(?:\s+TRANSACTION\s+LOG\s+RETENTION\s+(?P<keep>\d+\s+\w+))?(?P<dry>\s+DRY\s+RUN)?", purge),
            (rf"DROP\s+{_KIND}\s+PARTITIONS\s+FROM\s+{_PATH}\s+WHERE\s+(?P<where>.+?)", drop),
            (rf"REPAIR\s+{_KIND}\s+TRANSACTION\s+LOG\s+{_PATH}\s+AT\s+LOCATION\s+(?P<target>'[^']+')", repair),
            (rf"FLUSH\s+{_KIND}\s+(?:SEARCHER|DISK)\s+CACHE", flush),
            (rf"INVALIDATE\s+{_KIND}\s+TRANSACTION\s+LOG\s+CACHE(?:\s+FOR\s+{_PATH})?", invalidate),
            (rf"DESCRIBE\s+{_KIND}\s+TRANSACTION\s+LOG\s+{_PATH}(?P<all>\s+INCLUDE\s+ALL)?", lambda g: maintenance.describe_log(self.table(g["path"]), bool(g["all"]))),
            (rf"DESCRIBE\s+{_KIND}\s+(?:DISK\s+CACHE|STORAGE\s+STATS)", storage),
            (rf"DESCRIBE\s+{_KIND}\s+ENVIRONMENT", lambda g: maintenance.describe_environment(self.spark)),
            (rf"DESCRIBE\s+{_KIND}\s+STATE\s+{_PATH}", lambda g: maintenance.describe_state(self.table(g["path"]))),
            (rf"DESCRIBE\s+{_KIND}\s+COMPONENT\s+SIZES\s+{_PATH}{_WHERE}", lambda g: maintenance.describe_sizes(self.table(g["path"]), conditions(g["where"]))),
            (rf"PREWARM\s+{_KIND}\s+CACHE\s+(?:FOR\s+(?!SEGMENTS\b))?{_PATH}(?:\s+FOR\s+SEGMENTS\s*{_list('segments')})?(?:\s+ON\s+FIELDS\s*{_list('fields')})?(?:\s+WITH\s+PERWORKER\s+PARALLELISM\s+OF\s+(?P<parallelism>\d+))?{_WHERE}(?P<async_>\s+ASYNC(?:\s+MODE)?)?", prewarm),
            (rf"DESCRIBE\s+{_KIND}\s+PREWARM\s+JOBS", jobs),
            (rf"DESCRIBE\s+{_KIND}\s+MERGE\s+JOBS", lambda g: self.rows(self.merges, "path string, groups long, status string")),
            (rf"WAIT\s+FOR\s+{_KIND}\s+PREWARM\s+JOBS(?:\s+(?!(?:JOB|TIMEOUT)\b){_PATH})?(?:\s+JOB\s+(?P<id>'[^']+'))?(?:\s+TIMEOUT\s+(?P<seconds>\d+))?", wait),
            (rf"(?:CHECKPOINT|COMPACT)\s+{_KIND}\s+{_PATH}", checkpoint),
            (rf"TRUNCATE\s+{_KIND}\s+TIME\s+TRAVEL\s+{_PATH}(?P<dry>\s+DRY\s+RUN)?", truncate),
            (
                rf"BUILD\s+{_KIND}\s+COMPANION\s+FOR\s+(?P<kind>PARQUET|DELTA|ICEBERG)\s+{_PATH}(?:\s+SCHEMA\s+SOURCE\s+(?P<schema>{_STRING}))?(?:\s+CATALOG\s+(?P<catalog>{_STRING})(?:\s+TYPE\s+(?P<type>{_STRING}))?)?"
                rf"(?:\s+WAREHOUSE\s+(?P<warehouse>{_STRING}))?(?:\s+INCLUDE\s+COLUMNS\s*{_list('include')})?(?:\s+EXCLUDE\s+COLUMNS\s*{_list('exclude')})?(?:\s+INDEXING\s+MODES\s*{_list('modes')})?"
                rf"(?:\s+FASTFIELDS\s+MODE\s+(?P<fast>HYBRID|DISABLED|PARQUET_ONLY))?(?:\s+HASHED\s+FASTFIELDS\s+(?P<hashed_how>INCLUDE|EXCLUDE)\s*{_list('hashed')})?(?:\s+TARGET\s+INPUT\s+SIZE\s+(?P<size>\w+|{_STRING}))?"
                rf"(?:\s+WRITER\s+HEAP\s+SIZE\s+(?P<heap>\w+|{_STRING}))?(?:\s+FROM\s+VERSION\s+(?P<version>\d+))?(?:\s+FROM\s+SNAPSHOT\s+(?P<snapshot>\d+))?{_WHERE}(?P<all>\s+INVALIDATE\s+ALL\s+PARTITIONS)?"
                rf"(?:\s+TABLE\s+ROOTS\s*{_list('roots')})?\s+AT\s+LOCATION\s+(?P<index>{_STRING})(?:\s+WHERE\s+(?P<where2>.+?))?(?P<dry>\s+DRY\s+RUN)?"
                r"(?:\s+WITH\s+STREAMING\s+POLL\s+INTERVAL\s+(?P<seconds>\d+)\s+(?P<unit>SECONDS?|MINUTES?))?(?P<dry2>\s+DRY\s+RUN)?",
                build,
            ),
            (rf"SET\s+{_KIND}\s+TABLE\s+ROOT\s+(?:(?P<name>{_STRING})\s*=\s*)?(?P<root>{_STRING})\s+(?:FOR|AT)\s+{_PATH}", root),
            (rf"UNSET\s+{_KIND}\s+TABLE\s+ROOT\s+(?:(?P<name>{_STRING})\s+)?(?:FOR|AT)\s+{_PATH}", root),
            (rf"DESCRIBE\s+{_KIND}\s+TABLE\s+ROOTS\s+(?:FOR|AT)\s+{_PATH}", roots),
            (rf"(?P<what>ENABLE|DISABLE|DESCRIBE|RESET)\s+{_KIND}\s+PROFILER(?:\s+CACHE)?", profiler),
        ]


def _hours(text: str | None, default):
    if not text:
        return default
    n, unit = text.split()
    return int(n) * {"h": 1, "d": 24, "m": 1 / 60}[unit[0].lower()]
