"""Change events: matching, debouncing, batching and rate limits.

Functions take a batch or a streaming frame where Spark allows both. Event time
and watermarks are ours: the stream is ordered by its own timestamps, so a replay
gives the same result as the live run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.functions import paths, patterns
from treelake.streaming import sequential

PRIORITY = {"delete": 3, "rename": 2, "create": 1, "modify": 0}


def priority(kind: Column) -> Column:
    out = F.lit(0)
    for name, n in PRIORITY.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def match_subscriptions(events: DataFrame, subscriptions: list[tuple[str, str]]) -> DataFrame:
    """subscriptions: (connection, pattern), an argument of at most some hundreds for a connection.

    Each connection gets an event once, however many of its patterns fit: the
    connections of an event are an array of its own row, so nothing is joined or made distinct.
    """
    by: dict[str, list[str]] = {}
    for who, pattern in subscriptions:
        by.setdefault(who, []).append(patterns.subscription(pattern))
    hits = [F.when(F.col("path").rlike("|".join(f"(?:{p})" for p in ps)), F.lit(who)) for who, ps in sorted(by.items())]
    return events.withColumn("connection", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))) if hits else events.withColumn("connection", F.lit("")).where("false")


def accepted(requests: DataFrame, order: str, most: int = 100) -> DataFrame:
    """requests: (connection, pattern, order). Those that become subscriptions: (connection, pattern, place).

    Patterns are normalised; a connection's repeated pattern is refused, as are those after its first ``most`` (0: no limit).
    """
    rows = requests.groupBy("connection", paths.normalize_col(F.col("pattern")).alias("pattern")).agg(F.min(order).alias("place"))
    if most == 0:
        return rows
    turn = F.row_number().over(Window.partitionBy("connection").orderBy("place", "pattern"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).drop("turn")


def match_watchers(events: DataFrame, watchers: list[tuple[str, str, bool]]) -> DataFrame:
    """watchers: (name, path, recursive). Adds watcher and filename relative to it."""
    hits = []
    for name, path, recursive in watchers:
        base = path.rstrip("/")
        rest = F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))
        below = F.col("path").startswith(base + "/")
        test = (F.col("path") == path) | (below if recursive else below & ~rest.contains("/"))
        file = F.when(F.col("path") == path, F.element_at(F.split("path", "/"), -1)).otherwise(rest)
        hits.append(F.when(test, F.struct(F.lit(name).alias("watcher"), file.alias("filename"))))
    return events.withColumn("w", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))).select("*", "w.watcher", "w.filename").drop("w")


def delay(path: Column, rules: list[tuple[str, int]], default: int) -> Column:
    """Milliseconds for a path: an equal rule, then one for an ancestor, then a pattern; the first of each kind."""
    wild = [(p, ms) for p, ms in rules if any(c in p for c in "*?[{")]
    plain = [(p, ms) for p, ms in rules if (p, ms) not in wild]
    tests = [(path == p, ms) for p, ms in plain]
    tests += [(path.startswith(p.rstrip("/") + "/"), ms) for p, ms in plain]
    tests += [(patterns.lower(p, dot=True).column(path), ms) for p, ms in wild]
    out = F.lit(default)
    for test, ms in reversed(tests):
        out = F.when(test, F.lit(ms)).otherwise(out)
    return out


def debounce(events: DataFrame, gap: str | Column = "50 milliseconds", mode: str = "trailing") -> DataFrame:
    """A row for each burst of a path: (path, started, last, events, type).

    A burst ends when the path is quiet for the gap: a session window. The type is
    rename if the first or the last event is one, else change. Leading gives the
    burst's start, trailing its last event's time, both two rows.
    """
    rows = events.groupBy(F.session_window("ts", gap).alias("s"), "path").agg(
        F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("events"), F.min_by("type", F.struct("ts", "event_id")).alias("a"), F.max_by("type", F.struct("ts", "event_id")).alias("b")
    )
    rows = rows.withColumn("type", F.when((F.col("a") == "rename") | (F.col("b") == "rename"), "rename").otherwise("change"))
    edges = {"leading": ["started"], "trailing": ["last"], "both": ["started", "last"]}[mode]
    rows = rows.withColumn("emitted", F.explode(F.array(*edges)) if len(edges) > 1 else F.col(edges[0]))
    return rows.select("path", "started", "last", "events", "type", "emitted")


def fold(types: Column) -> Column:
    """One type from a path's types in order: a delete wins over what was, create and rename stay, else the newest."""
    step = lambda old, new: F.when(old == "", new).when(new == "delete", new).when(old.isin("create", "rename"), old).otherwise(new)
    return F.aggregate(types, F.lit(""), step)


def batch(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window, path, type, events, priority) for each tumbling window and path.

    The type is what ``fold`` gives: after the last delete, the first create or rename, else the newest event. A table's
    events are marked within their window and path, so no array of them is built, however many one path has. A stream
    can't look back at rows: there it folds an array, kept in state, of a path's events in a window.
    """
    event = F.struct("ts", "event_id", "type")
    if events.isStreaming:
        ordered = F.transform(F.array_sort(F.collect_list(event)), lambda x: x["type"])
        rows = events.groupBy(F.window("ts", width).alias("w"), "path").agg(ordered.alias("types"))
        rows = rows.select("w", "path", fold(F.col("types")).alias("type"), F.size("types").cast("long").alias("events"))
    else:
        rows = events.select(F.window("ts", width).alias("w"), "path", event.alias("e"))
        last = F.max(F.when(F.col("e.type") == "delete", F.col("e"))).over(Window.partitionBy("w", "path"))
        rows = rows.withColumn("sticky", F.col("e.type").isin("create", "rename") & F.coalesce(F.col("e") > last, F.lit(True)))
        rows = rows.groupBy("w", "path").agg(F.max("e").alias("newest"), F.min(F.when(F.col("sticky"), F.col("e"))).alias("first"), F.count("*").alias("events"))
        kind = F.when(F.col("newest.type") == "delete", "delete").otherwise(F.when(F.col("first").isNotNull(), F.col("first.type")).otherwise(F.col("newest.type")))
        rows = rows.select("w", "path", kind.alias("type"), "events")
    rows = rows.select(F.col("w.start").alias("window"), "path", "type", "events")
    return rows.withColumn("priority", priority(F.col("type")))


def batch_metrics(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(received, emitted, batches, compression) over all batches."""
    rows = events.groupBy(F.window("ts", width).alias("w"), "path").agg(F.count("*").alias("n"))
    by_window = rows.groupBy("w").agg(F.sum("n").alias("received"), F.count("*").alias("emitted"))
    return by_window.agg(F.sum("received").alias("received"), F.sum("emitted").alias("emitted"), F.count("*").alias("batches"), (F.sum("received") / F.sum("emitted")).alias("compression"))


def batch_latency(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(average_size, average_latency_ms, per_second) over all batches, null without events.

    Latency runs from a path's first event in a window to the window's end, when its batch goes; the rate is of emitted
    events from the first window's start to the last one's end.
    """
    rows = events.groupBy(F.window("ts", width).alias("w"), "path").agg(F.min("ts").alias("first"))
    rows = rows.withColumn("ms", F.unix_millis("w.end") - F.unix_millis("first"))
    by_window = rows.groupBy("w").agg(F.count("*").alias("emitted"), F.sum("ms").alias("ms"))
    seconds = (F.unix_millis(F.max("w.end")) - F.unix_millis(F.min("w.start"))) / 1000
    return by_window.agg((F.sum("emitted") / F.count("*")).alias("average_size"), (F.sum("ms") / F.sum("emitted")).alias("average_latency_ms"), (F.sum("emitted") / seconds).alias("per_second"))


def stream_batches(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """batch on a stream, with a watermark for late events."""
    return batch(events.withWatermark("ts", late), width)


def stream_debounce(events: DataFrame, gap: str = "50 milliseconds", late: str = "10 minutes") -> DataFrame:
    return debounce(events.withWatermark("ts", late), gap)


def rate_limit(events: DataFrame, key: str = "user_id", most: int = 100, per_ms: int = 1000, burst: int = 20, burst_ms: int = 100) -> DataFrame:
    """events with allowed: sliding limits of which only allowed events use up budget.

    Sequential for each key: state is the times of at most ``most`` allowed events.
    """
    return sequential.apply(events, sequential.sliding_limit(most, per_ms, burst, burst_ms), key)


def stale(events: DataFrame, key: str = "user_id", idle: str = "90 seconds") -> DataFrame:
    """(key, since, until) of a connection's live spells: it is dropped after being idle."""
    rows = events.groupBy(F.session_window("ts", idle).alias("s"), key).agg(F.count("*").alias("pings"))
    return rows.select(key, F.col("s.start").alias("since"), F.col("s.end").alias("until"), "pings")
