"""Text commands over one set of series: each is parsed and becomes a plan of the operators.

    engine = Engine(spark)
    engine.execute('TS.CREATE t LABELS room kitchen DUPLICATE_POLICY last')
    engine.execute('TS.MADD t 1000 20.5 t 2000 21')
    engine.execute('TS.RANGE t - + AGGREGATION avg,max 1m').show()

Reads return lazy DataFrames. Writes replace the engine's frames; with a folder each write is
stored there as a new Parquet version, which keeps plans short, and without one they add
to the frames' lineage, which suits tests. Bulk data is better given as frames.

A folder also holds the rules and which versions are current, one row for each write. An engine that is made for a
folder begins with what is stored there, and a blocking read looks there again at every poll, so it sees
what other engines have written meanwhile. One engine at a time may write.
"""

from __future__ import annotations

import json
import re
import shlex
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.literals import parse_duration, parse_number, parse_timestamp, parse_window
from .operators import labels as L
from .operators import multi as M
from .operators import writes as W
from .operators.joins import joined_range
from .operators.outliers.detect import outliers
from .operators.ranges import last_sample, read_after, scan
from .plans.query import Aggregation, RangeQuery, aggregation, range_query
from .plans.selectors import parse_metric
from .sources.json_bulk import parse_bulk
from .streaming import rules as R
from .streaming.tail import blocking_read

SAMPLES = "key string, ts long, value double"


class CommandError(ValueError):
    """A command that can't be parsed or carried out."""


class Args:
    """A command's words: positional ones first, then options in any order."""

    def __init__(self, words: Sequence[str]):
        self.words, self.i = list(words), 0

    def more(self) -> bool:
        return self.i < len(self.words)

    def peek(self) -> str:
        return self.words[self.i].upper() if self.more() else ""

    def next(self, what: str = "a word") -> str:
        if not self.more():
            raise CommandError(f"{what} is missing")
        self.i += 1
        return self.words[self.i - 1]

    def flag(self, *names: str) -> str | None:
        if self.peek() in names:
            return self.next().upper()
        return None

    def until(self, stops: Sequence[str]) -> list[str]:
        out = []
        while self.more() and self.peek() not in stops:
            out.append(self.next())
        return out


RANGE_WORDS = ("LATEST", "FILTER_BY_TS", "FILTER_BY_VALUE", "COUNT", "ALIGN", "AGGREGATION", "BUCKETTIMESTAMP", "EMPTY")
MULTI_WORDS = (*RANGE_WORDS, "WITHLABELS", "SELECTED_LABELS", "FILTER", "GROUPBY", "REDUCE", "EXCLUDEEMPTY", "FILTER_BY_RANGE")
SERIES_WORDS = ("RETENTION", "ENCODING", "CHUNK_SIZE", "DUPLICATE_POLICY", "ON_DUPLICATE", "METRIC", "LABELS", "IGNORE", "SIGNIFICANT_DIGITS", "DECIMAL_DIGITS", "TIMESTAMP")
SEARCH_WORDS = ("SEARCH", "FUZZY_THRESHOLD", "FUZZY_ALGORITHM", "IGNORE_CASE", "INCLUDE_METADATA", "SORTBY", "LIMIT", "FILTER", "FILTER_BY_RANGE")
OUTLIER_WORDS = ("OUTPUT", "DIRECTION", "SEASONALITY", "METHOD")
METHOD_OPTIONS = {"ALPHA": "alpha", "LAG": "lag", "INFLUENCE": "influence", "MAX_OUTLIERS": "max_outliers", "NUM_TREES": "trees", "SAMPLE_SIZE": "sample", "SHINGLE_SIZE": "shingle", "CONTAMINATION": "contamination"}


class Engine:
    def __init__(self, spark: SparkSession, samples: DataFrame | None = None, series: DataFrame | None = None, folder: str | None = None, clock: Callable[[], int] | None = None, auto: Sequence[tuple[str, str]] = ()):
        """``auto`` has pairs of a pattern, which a whole key must match, and the rules that a new series of such a key gets."""
        self.spark, self.folder, self.rules, self.auto = spark, folder, [], list(auto)
        self.paths: dict[str, str] = {}
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.samples = spark.createDataFrame([], SAMPLES) if samples is None else samples.select("key", "ts", "value")
        empty = spark.createDataFrame([], W.SERIES)
        if series is not None:
            series = empty.unionByName(series, allowMissingColumns=True).fillna({"retention_ms": 0, "ignore_ms": 0, "ignore_value": 0.0, "duplicate_policy": "block"})
        self.series, self.versions = empty if series is None else series, 0
        if folder and samples is None and series is None:
            self._load()

    def execute(self, command: str | Sequence[str]) -> DataFrame:
        words = shlex.split(command) if isinstance(command, str) else list(command)
        name = words[0].upper().removeprefix("TS.").lower() if words else ""
        run = getattr(self, f"_{name}", None) if name in COMMANDS else None
        if run is None:
            raise CommandError(f"unknown command {words[:1]}")
        args = Args(words[1:])
        try:
            out = run(args)
        except CommandError:
            raise
        except ValueError as e:
            raise CommandError(str(e)) from e
        if args.more():
            raise CommandError(f"unexpected {args.peek()!r}")
        return out

    # State

    def _store(self, samples: DataFrame | None = None, series: DataFrame | None = None, rules: list[R.Rule] | None = None) -> None:
        rules = self.rules if rules is None else rules
        if self.folder:
            number = self.versions + 1
            paths = self.paths | {what: f"{self.folder}/{what}-{number}" for what, df in (("samples", samples), ("series", series)) if df is not None}
            samples = samples and self._written(samples, paths["samples"])
            series = series and self._written(series, paths["series"])
            told = [[r.source, r.dest, r.aggregator.name + (f"({r.aggregator.op} {r.aggregator.operand!r})" if r.aggregator.op else ""), r.bucket_ms, r.align, r.retention_ms] for r in rules]
            self._written(self._one(paths=json.dumps(paths), rules=json.dumps(told)), f"{self.folder}/state-{number}")  # from here on the write counts
            self.versions, self.paths = number, paths
        self.rules = rules
        self.samples = self.samples if samples is None else samples
        self.series = self.series if series is None else series

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _load(self) -> None:
        """Takes over the newest state of the folder, if there is one that is newer."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state-*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        number = max((int(f.getPath().getParent().getName().removeprefix("state-")) for f in found), default=0)
        if number <= self.versions:
            return
        state = self.spark.read.parquet(f"{self.folder}/state-{number}").first()
        self.versions, self.paths = number, json.loads(state.paths)
        self.rules = [R.rule(source, dest, name, bucket, align, retention) for source, dest, name, bucket, align, retention in json.loads(state.rules)]
        for what, schema in (("samples", SAMPLES), ("series", W.SERIES)):
            if what in self.paths:
                setattr(self, what, self.spark.read.schema(schema).parquet(self.paths[what]))

    def _one(self, **columns) -> DataFrame:
        return self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])

    def _find(self, key: str):
        return self.series.where(F.col("key") == key).first()

    def _need(self, key: str):
        row = self._find(key)
        if row is None:
            raise CommandError(f"no series {key!r}")
        return row

    def _of(self, key: str, latest: bool = False) -> DataFrame:
        self._need(key)
        return self._live(self.samples.where(F.col("key") == key), latest)

    def _live(self, samples: DataFrame, latest: bool = False) -> DataFrame:
        """Samples within their series' retention, with the open buckets of destinations if asked for."""
        ages = self.series.where("retention_ms > 0").select("key", "retention_ms")
        last = samples.groupBy("key").agg(F.max("ts").alias("_last")).join(ages, "key").select("key", (F.col("_last") - F.col("retention_ms")).alias("_floor"))
        live = samples.join(last, "key", "left").where("_floor IS NULL OR ts >= _floor").drop("_floor")
        for r in self.rules if latest else ():
            now = R.latest(live.limit(0), self.samples, r).join(live.where(F.col("key") == r.dest).select("key", "ts"), ["key", "ts"], "left_anti")
            live = live.unionByName(now.join(samples.select("key").distinct(), "key", "left_semi"))
        return live

    # Parsing that commands share

    def _series_options(self, a: Args) -> tuple[dict, str | None, int | None]:
        """Series properties, a policy for this call only, and a timestamp."""
        found: dict = {}
        once = stamp = None
        while a.more():
            word = a.next().upper()
            match word:
                case "RETENTION":
                    found["retention_ms"] = parse_duration(a.next())
                case "ENCODING" | "CHUNK_SIZE":
                    a.next()  # storage is Parquet's
                case "DUPLICATE_POLICY":
                    found["duplicate_policy"] = a.next().lower()
                case "ON_DUPLICATE":
                    once = a.next().lower()
                case "IGNORE":
                    found["ignore_ms"], found["ignore_value"] = parse_duration(a.next()), parse_number(a.next())
                case "DEDUPE_INTERVAL":
                    found["ignore_ms"] = parse_duration(a.next())
                case "SIGNIFICANT_DIGITS":
                    found["significant"] = int(a.next())
                case "DECIMAL_DIGITS":
                    found["decimals"] = int(a.next())
                case "METRIC":
                    found["labels"] = parse_metric(a.next())
                case "LABELS":
                    words = a.until(SERIES_WORDS)
                    if len(words) % 2:
                        raise CommandError("a label without a value")
                    found["labels"] = dict(zip(words[::2], words[1::2], strict=True))
                case "TIMESTAMP":
                    stamp = self._stamp(a.next())
                case _:
                    raise CommandError(f"unexpected {word!r}")
        for policy in (once, found.get("duplicate_policy")):
            if policy is not None and policy not in W.POLICIES:
                raise CommandError(f"unknown policy {policy!r}")
        return found, once, stamp

    def _stamp(self, text: str) -> int:
        return self.clock() if text == "*" else parse_timestamp(text)

    def _aggregation(self, a: Args, align: str | None) -> Aggregation:
        names = a.next("an aggregator")
        while a.more() and ("(" in names and names.count("(") > names.count(")") or names.endswith(",") or a.peek().startswith(("(", ","))):
            names += " " + a.next()
        bucket, report, empty = a.next("a bucket"), "start", False
        while word := a.flag("BUCKETTIMESTAMP", "EMPTY", "ALIGN"):
            if word == "EMPTY":
                empty = True
            elif word == "ALIGN":
                align = a.next()
            else:
                report = a.next().lower()
        return aggregation(names, bucket, align, report, empty)

    def _query(self, a: Args, start: str, end: str, reverse: bool, words: Sequence[str] = RANGE_WORDS) -> tuple[RangeQuery, dict]:
        """A range query, and the multi-series options that came with it; stops at other words."""
        o: dict = {"by_ts": None, "by_value": None, "count": None, "aggregate": None}
        extra: dict = {}
        align = None
        while a.peek() in words:
            match a.next().upper():
                case "LATEST":
                    extra["latest"] = True
                case "FILTER_BY_TS":
                    o["by_ts"] = a.until(words)
                case "FILTER_BY_VALUE":
                    o["by_value"] = (parse_number(a.next()), parse_number(a.next()))
                case "COUNT":
                    o["count"] = int(a.next())
                case "ALIGN":
                    align = a.next()
                case "AGGREGATION":
                    o["aggregate"] = self._aggregation(a, align)
                case "WITHLABELS":
                    extra["labels"] = None
                case "SELECTED_LABELS":
                    extra["labels"] = a.until(words)
                case "FILTER":
                    extra["filter"] = a.until(words)
                case "GROUPBY":
                    extra["group"] = a.next()
                case "REDUCE":
                    extra["reduce"] = " ".join(a.until(words))
                case "EXCLUDEEMPTY":
                    extra["exclude"] = True
                case "FILTER_BY_RANGE":
                    extra["range"] = self._having(a)
                case other:
                    raise CommandError(f"unexpected {other!r}")
        stamp = lambda t: t if isinstance(t, int) or not t.isdigit() else int(t)
        return range_query(stamp(start), stamp(end), now=self.clock(), reverse=reverse, **o), extra

    def _having(self, a: Args) -> tuple[bool, RangeQuery]:
        negate = bool(a.flag("NOT"))
        return negate, RangeQuery(parse_window(a.next(), a.next(), self.clock()))

    def _chosen(self, filters: Sequence[str] | None, having: tuple[bool, RangeQuery] | None) -> DataFrame:
        series = M.select_series(self.series, filters) if filters else self.series
        return M.having_samples(series, self.samples, having[1], having[0]) if having else series

    # Writes

    def _create(self, a: Args) -> DataFrame:
        key = a.next("a key")
        options, _, _ = self._series_options(a)
        if self._find(key):
            raise CommandError(f"series {key!r} exists")
        self._new(key, options)
        return self._one(ok=True)

    def _alter(self, a: Args) -> DataFrame:
        key = a.next("a key")
        self._need(key)
        options, _, _ = self._series_options(a)
        self._store(series=W.alter_series(self.series, key, **options))
        return self._one(ok=True)

    def _ensure(self, key: str, options: dict):
        row = self._find(key)
        if row is None:
            self._new(key, options)
            row = self._find(key)
        return row

    def _new(self, key: str, options: dict) -> None:
        """Creates a series, and the destinations and rules that ``auto`` has for it; a destination gets none of its own."""
        series, rules = self.series.unionByName(W.create_series(self.spark, key, **options)), self.rules
        for r in (r for pattern, policies in self.auto if re.fullmatch(pattern, key) for r in R.auto_rules(key, policies)):
            if self._find(r.dest) is None:
                kept = {"retention_ms": r.retention_ms, "labels": options.get("labels")}
                series = series.unionByName(W.create_series(self.spark, r.dest, **kept))
            rules = R.add_rule(rules, r)
        self._store(series=series, rules=rules)

    def _write(self, incoming: DataFrame, row, policy: str | None = None) -> DataFrame:
        """Merges samples of one series (key, ts, value, arrival); returns those written."""
        policy = policy or row.duplicate_policy
        stored = self.samples.where(F.col("key") == row.key)
        incoming = W.rounded(incoming, row.significant, row.decimals)
        if row.retention_ms:
            incoming = W.retention_gate(incoming, row.retention_ms, last_sample(stored)).where("accepted").drop("accepted")
        if policy == "last" and row.ignore_ms:
            last = last_sample(stored).withColumn("arrival", F.lit(-1).cast("long"))
            incoming = W.drop_repeats(last.unionByName(incoming), row.ignore_ms, row.ignore_value).where("arrival >= 0")
        if policy == "block":
            incoming = incoming.join(W.blocked(stored, incoming).select("arrival"), "arrival", "left_anti").select("key", "ts", "value", "arrival")
        merged = W.merge_samples(stored, incoming, policy)
        samples = self.samples.where(F.col("key") != row.key).unionByName(merged)
        for r in R.ordered_rules(self.rules):
            if r.source == row.key or any(r.source == o.dest for o in self.rules):
                dest = R.refresh(samples.where(F.col("key") == r.dest), samples, incoming.select("key", "ts", "value"), r)
                samples = samples.where(F.col("key") != r.dest).unionByName(dest)
        self._store(samples=samples)
        return incoming

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame([(k, t, v, i) for i, (k, t, v) in enumerate(rows)], SAMPLES + ", arrival long")

    def _add(self, a: Args) -> DataFrame:
        key, ts, value = a.next("a key"), self._stamp(a.next("a timestamp")), parse_number(a.next("a value"))
        options, once, _ = self._series_options(a)
        row = self._ensure(key, options)
        policy = once or row.duplicate_policy
        if policy == "block" and self.samples.where((F.col("key") == key) & (F.col("ts") == ts)).limit(1).count():
            raise CommandError("a sample with this timestamp exists")
        self._write(self._rows([(key, ts, value)]), row, policy)
        return self._one(ts=ts)

    def _madd(self, a: Args) -> DataFrame:
        rows, groups = [], {}
        while a.more():
            rows.append((a.next(), self._stamp(a.next("a timestamp")), parse_number(a.next("a value"))))
        for k, t, v in rows:
            groups.setdefault(k, []).append((k, t, v))
        written = None
        for key, part in groups.items():
            row = self._find(key)
            if row is not None:
                done = self._write(self._rows(part), row).select("key", "ts")
                written = done if written is None else written.unionByName(done)
        return self.spark.createDataFrame([], "key string, ts long") if written is None else written

    def _addbulk(self, a: Args) -> DataFrame:
        key, payload = a.next("a key"), a.next("data")
        options, once, _ = self._series_options(a)
        parsed = parse_bulk(self.spark.createDataFrame([(key, 0, payload)], "key string, arrival long, payload string"))
        error = parsed.where("error IS NOT NULL").first()
        if error:
            raise CommandError(error.error)
        row = self._ensure(key, options)
        written = self._write(parsed.drop("error"), row, once)
        return written.agg(F.count(F.lit(1)).alias("added"))

    def _incrby(self, a: Args, sign: int = 1) -> DataFrame:
        key, delta = a.next("a key"), sign * parse_number(a.next("a value"))
        options, _, stamp = self._series_options(a)
        row = self._ensure(key, options)
        ts = self.clock() if stamp is None else stamp
        deltas = self.spark.createDataFrame([(key, ts, delta, 0)], "key string, ts long, delta double, arrival long")
        new = W.increments(self.samples.where(F.col("key") == key), deltas).first()
        if new is None:
            raise CommandError("the timestamp is older than the last sample, or that is NaN")
        self._write(self._rows([(key, new.ts, new.value)]), row, "last")
        return self._one(ts=ts)

    def _decrby(self, a: Args) -> DataFrame:
        return self._incrby(a, -1)

    def _del(self, a: Args) -> DataFrame:
        key, query = a.next("a key"), RangeQuery(parse_window(a.next(), a.next(), self.clock()))
        self._need(key)
        mine = self.samples.where(F.col("key") == key)
        return self._remove(mine, query)

    def _remove(self, mine: DataFrame, query: RangeQuery) -> DataFrame:
        left, _ = W.delete_range(mine, query)
        gone = mine.join(left.select("key", "ts"), ["key", "ts"], "left_anti")
        count = gone.count()
        samples = self.samples.join(gone.select("key", "ts"), ["key", "ts"], "left_anti")
        for r in R.ordered_rules(self.rules):
            dest = R.refresh(samples.where(F.col("key") == r.dest), samples, gone, r)
            samples = samples.where(F.col("key") != r.dest).unionByName(dest)
        self._store(samples=samples)
        return self._one(deleted=count)

    def _mdel(self, a: Args) -> DataFrame:
        window = None if a.peek() == "FILTER" else RangeQuery(parse_window(a.next(), a.next(), self.clock()))
        if not a.flag("FILTER"):
            raise CommandError("FILTER is missing")
        keys = M.select_series(self.series, a.until(())).select("key")
        if window:
            return self._remove(self.samples.join(keys, "key", "left_semi"), window)
        n = keys.count()
        series = self.series.join(keys, "key", "left_anti")
        self._store(samples=self.samples.join(keys, "key", "left_anti"), series=series)
        return self._one(deleted=n)

    def _createrule(self, a: Args) -> DataFrame:
        source, dest = a.next("a source"), a.next("a destination")
        if not a.flag("AGGREGATION"):
            raise CommandError("AGGREGATION is missing")
        name = a.next()
        while "(" in name and ")" not in name:
            name += " " + a.next()
        bucket, align = a.next("a bucket"), parse_timestamp(a.next()) if a.more() else 0
        self._need(source), self._need(dest)
        self._store(rules=R.add_rule(self.rules, R.rule(source, dest, name, bucket, align)))
        return self._one(ok=True)

    def _deleterule(self, a: Args) -> DataFrame:
        self._store(rules=R.drop_rule(self.rules, a.next(), a.next()))
        return self._one(ok=True)

    # Reads of one series

    def _get(self, a: Args) -> DataFrame:
        key = a.next("a key")
        return last_sample(self._of(key, bool(a.flag("LATEST")))).select("ts", "value")

    def _range(self, a: Args, reverse: bool = False) -> DataFrame:
        key, start, end = a.next("a key"), a.next("a start"), a.next("an end")
        query, extra = self._query(a, start, end, reverse)
        out = scan(self._of(key, extra.get("latest", False)), query).drop("key")
        return out.orderBy(F.desc("ts") if reverse else F.asc("ts"))

    def _revrange(self, a: Args) -> DataFrame:
        return self._range(a, True)

    def _read(self, a: Args) -> DataFrame:
        key, cursor = a.next("a key"), a.next("a cursor")
        wait, least, most, op, operand = 0, 1, None, None, None
        while word := a.flag("BLOCK", "MAX_COUNT", "CONDITION"):
            if word == "BLOCK":
                wait, least = int(a.next()), int(a.next())
            elif word == "MAX_COUNT":
                most = int(a.next())
            else:
                op, operand = a.next(), parse_number(a.next())

        def load() -> DataFrame:
            if self.folder and wait:
                self._load()
            return self.samples.where(F.col("key") == key)

        if wait:
            return blocking_read(load, cursor, least, wait, most, op, operand).drop("key").orderBy("ts")
        return read_after(load(), cursor, op, operand, most).drop("key").orderBy("ts")

    def _info(self, a: Args) -> DataFrame:
        key = a.next("a key")
        a.flag("DEBUG")
        self._need(key)
        mine = F.col("key") == key
        rules = F.array(*[F.struct(F.lit(r.dest).alias("dest"), F.lit(r.aggregator.name).alias("aggregator"), F.lit(r.bucket_ms).alias("bucket_ms"), F.lit(r.align).alias("align")) for r in self.rules if r.source == key])
        source = next((r.source for r in self.rules if r.dest == key), None)
        return W.series_info(self.series.where(mine), self._live(self.samples.where(mine))).withColumns({"rules": rules, "source_key": F.lit(source)})

    def _outliers(self, a: Args) -> DataFrame:
        key, start, end = a.next("a key"), a.next("a start"), a.next("an end")
        o: dict = {"output": "simple", "direction": "both", "seasonality": None}
        method, options = "zscore", {}
        while a.more():
            match a.next().upper():
                case "OUTPUT":
                    o["output"] = a.next().lower()
                case "DIRECTION":
                    o["direction"] = a.next().lower()
                case "SEASONALITY":
                    words = a.until((*OUTLIER_WORDS, *METHOD_OPTIONS))
                    o["seasonality"] = "auto" if [w.upper() for w in words] == ["AUTO"] else [int(w) for w in words]
                case "METHOD":
                    method = a.next().lower()
                case "THRESHOLD":
                    options["threshold"] = parse_number(a.next())
                case "ESTIMATOR":
                    options["estimator"] = a.next().lower()
                case "HYBRID" | "CLASSIC" as word:
                    options["hybrid"] = word == "HYBRID"
                case word if word in METHOD_OPTIONS:
                    value = parse_number(a.next())
                    options[METHOD_OPTIONS[word]] = int(value) if word not in ("ALPHA", "INFLUENCE", "CONTAMINATION") else value
                case word:
                    raise CommandError(f"unexpected {word!r}")
        if "threshold" in options and method in ("mad", "double-mad", "rcf"):
            options["sigmas" if method == "rcf" else "k"] = options.pop("threshold")
        query, _ = self._query(Args([]), start, end, False)
        return outliers(self._of(key), query, method, **o, **options).drop("key").orderBy("ts")

    # Reads of several series

    def _join(self, a: Args) -> DataFrame:
        left, right, start, end = (a.next("an argument") for _ in range(4))
        if left == right:
            raise CommandError("a series can't be joined with itself")
        kind, asof, op = "inner", {}, None
        if word := a.flag("INNER", "FULL", "LEFT", "RIGHT", "ANTI", "SEMI", "ASOF"):
            kind = word.lower()
        if kind == "asof":
            if word := a.flag("PREVIOUS", "NEXT", "NEAREST"):
                asof["direction"] = word.lower()
            if a.more() and a.peek() not in (*RANGE_WORDS, "REDUCE", "ALLOW_EXACT_MATCH"):
                asof["tolerance_ms"] = parse_duration(a.next())
            if a.flag("ALLOW_EXACT_MATCH"):
                asof["exact"] = a.next().lower() == "true" if a.peek() in ("TRUE", "FALSE") else True
        query, _ = self._query(a, start, end, False)
        while word := a.flag("REDUCE"):
            op = a.next().lower()
            more, _ = self._query(a, start, end, False)
            query = RangeQuery(query.window, query.by_ts or more.by_ts, query.by_value or more.by_value, query.count or more.count, query.aggregation or more.aggregation)
        plain = RangeQuery(query.window, query.by_ts, query.by_value, query.count)
        sides = [self._of(k).select("ts", "value") for k in (left, right)]
        return joined_range(*sides, plain, kind, op, query.aggregation, **asof).orderBy("ts")

    def _mget(self, a: Args) -> DataFrame:
        _, extra = self._query(a, "-", "+", False, MULTI_WORDS)
        chosen = M.select_series(self.series, extra.get("filter") or [])
        live = self._live(self.samples.join(chosen.select("key"), "key", "left_semi"), extra.get("latest", False))
        out = last_sample(live)
        return (M.with_labels(out, chosen, extra["labels"]) if "labels" in extra else out).orderBy("key")

    def _mrange(self, a: Args, reverse: bool = False) -> DataFrame:
        start, end = a.next("a start"), a.next("an end")
        query, extra = self._query(a, start, end, reverse, MULTI_WORDS)
        filters = extra.get("filter") or []
        chosen = self._chosen(filters, extra.get("range"))
        M.selector_column(filters, F.col("labels"))
        live = self._live(self.samples.join(chosen.select("key"), "key", "left_semi"), extra.get("latest", False))
        order = F.desc("ts") if reverse else F.asc("ts")
        if "group" in extra:
            if "reduce" not in extra or extra.get("exclude"):
                raise CommandError("GROUPBY needs REDUCE and takes no EXCLUDEEMPTY")
            return M.group_range(live, chosen, filters, query, extra["group"], extra["reduce"], "labels" in extra).orderBy("group", order)
        out = M.multi_range(live, chosen, filters, query, keep_empty=not extra.get("exclude"))
        return (M.with_labels(out, chosen, extra["labels"]) if "labels" in extra else out).orderBy("key", order)

    def _mrevrange(self, a: Args) -> DataFrame:
        return self._mrange(a, True)

    def _nrange(self, a: Args, reverse: bool = False) -> DataFrame:
        keys = [a.next("a key") for _ in range(int(a.next("a number")))]
        start, end = a.next("a start"), a.next("an end")
        query, extra = self._query(a, start, end, reverse)
        for k in set(keys):
            self._need(k)
        out = M.pivot(self._live(self.samples.where(F.col("key").isin(*keys)), extra.get("latest", False)), keys, query)
        return out.orderBy(F.desc("ts") if reverse else F.asc("ts"))

    def _nrevrange(self, a: Args) -> DataFrame:
        return self._nrange(a, True)

    # Labels

    def _queryindex(self, a: Args) -> DataFrame:
        having = self._having(a) if a.flag("FILTER_BY_RANGE") else None
        a.flag("FILTER")
        return self._chosen(a.until(()), having).select("key").orderBy("key")

    def _card(self, a: Args) -> DataFrame:
        having = filters = None
        while word := a.flag("FILTER_BY_RANGE", "FILTER"):
            if word == "FILTER":
                filters = a.until(("FILTER_BY_RANGE",))
            else:
                having = self._having(a)
        return L.cardinality(self._chosen(filters, having))

    def _querylabels(self, a: Args) -> DataFrame:
        label = None if a.next("LABELS or VALUES").upper() == "LABELS" else a.next("a label")
        filters = a.until(()) if a.flag("FILTER") else None
        return L.query_labels(self.series, label, filters).orderBy("value")

    def _search(self, a: Args, label: str | None) -> DataFrame:
        o: dict = {}
        having, metadata = None, False
        while word := a.flag(*SEARCH_WORDS):
            match word:
                case "SEARCH":
                    o["terms"] = a.until(SEARCH_WORDS)
                case "FUZZY_THRESHOLD":
                    o["threshold"] = parse_number(a.next())
                case "FUZZY_ALGORITHM":
                    o["algorithm"] = a.next().lower()
                case "IGNORE_CASE":
                    o["case_sensitive"] = False
                case "INCLUDE_METADATA":
                    metadata = True
                case "SORTBY":
                    o["sort_by"] = a.next().lower()
                    direction = a.flag("ASC", "DESC")
                    o["descending"] = direction == "DESC" if direction else o["sort_by"] == "score"
                case "LIMIT":
                    o["limit"] = int(a.next())
                case "FILTER":
                    o["selectors"] = a.until(SEARCH_WORDS)
                case "FILTER_BY_RANGE":
                    having = self._having(a)
        out = L.search_labels(self._chosen(None, having), label, **o)
        return out if metadata else out.select("value")

    def _labelnames(self, a: Args) -> DataFrame:
        return self._search(a, None)

    def _labelvalues(self, a: Args) -> DataFrame:
        return self._search(a, a.next("a label"))

    def _metricnames(self, a: Args) -> DataFrame:
        return self._search(a, L.NAME_LABEL)

    def _labelstats(self, a: Args) -> DataFrame:
        o: dict = {}
        while word := a.flag("LABEL", "LIMIT", "FILTER"):
            if word == "FILTER":
                o["selectors"] = a.until(("LABEL", "LIMIT"))
            else:
                o["focus" if word == "LABEL" else "limit"] = a.next() if word == "LABEL" else int(a.next())
        return L.label_stats(self.series, **o)


COMMANDS = frozenset(
    "add addbulk alter card create createrule deleterule decrby del get incrby info join labelnames labelstats labelvalues madd mdel mget metricnames mrange mrevrange nrange nrevrange outliers queryindex querylabels range read revrange".split()
)
