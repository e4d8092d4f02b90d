"""File events: debouncing, the latest state of each path, retries and the stream that applies them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounce(events: DataFrame, key: str, ts: str, op: str, gap: str = "500 milliseconds", late: str = "10 minutes", tie: str = "") -> DataFrame:
    """(key, began, op, n): events of a key that follow within `gap` are one, with the last operation (at the same time: by `tie`,
    or the greatest); batch or stream."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(key, F.session_window(ts, gap).alias("session")).agg(F.max_by(op, F.struct(ts, tie) if tie else F.struct(ts, op)).alias("op"), F.count("*").alias("n")).select(key, F.col("session.start").alias("began"), "op", "n")


def latest(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last event of each key: one row a key in each task is all that is shuffled."""
    rest = [c for c in events.columns if c not in (key, ts, tie)]
    last = F.max_by(F.struct(*rest), F.struct(ts, tie)) if rest else F.lit(None)
    rows = events.groupBy(key).agg(F.max(F.struct(ts, tie)).alias("_at"), last.alias("_rest"))
    return rows.select(key, f"_at.{ts}", f"_at.{tie}", *(f"_rest.{c}" for c in rest)).select(*events.columns)


def not_older(events: DataFrame, state: DataFrame, key: str, ts: str) -> DataFrame:
    """Events that aren't older than what is known of their key: results of a superseded version are dropped."""
    known = state.groupBy(key).agg(F.max(ts).alias("_known"))
    return events.join(known, key, "left").where(F.col("_known").isNull() | (F.col(ts) >= F.col("_known"))).drop("_known")


#: Errors that a retry won't mend, and those after which nothing happens.
FINAL = ("ocr_failed", "too_large", "permanent")
SILENT = ("canceled", "deadline_exceeded")


def error_action(error: Column) -> Column:
    """retry, quarantine or ignore."""
    return F.when(error.isNull() | error.isin(*SILENT), "ignore").when(error.isin(*FINAL), "quarantine").otherwise("retry")


def retry_state(failures: DataFrame, key: str, most: int = 3, step: int = 2) -> DataFrame:
    """(key, attempts, delay_s, state): the delay grows by two seconds with each attempt; beyond `most` a key is quarantined."""
    n = failures.groupBy(key).agg(F.count("*").alias("attempts"))
    return n.select(key, "attempts", F.when(F.col("attempts") <= most, F.col("attempts") * step).alias("delay_s"), F.when(F.col("attempts") <= most, "retry").otherwise("quarantine").alias("state"))


RETRY = "attempts int, version timestamp, due timestamp"


def schedule_retries(failures: DataFrame, key: str, version: str, error: str, state: DataFrame, now: Column, most: int = 3, step: int = 2) -> DataFrame:
    """(key, attempts, version, due, outcome) after one failure of each key, from the state before.

    A newer version of a key begins anew, an older failure is stale; errors that a retry won't mend are quarantined at once,
    others are given up after `most` attempts.
    """
    old = state.select(key, F.col("attempts").alias("_n"), F.col("version").alias("_v"))
    rows = failures.join(old, key, "left")
    attempts = F.when(F.col("_v").isNull() | (F.col(version) > F.col("_v")), 1).otherwise(F.col("_n") + 1)
    act = error_action(F.col(error))
    outcome = F.when(act != "retry", act).when(F.col(version) < F.col("_v"), "stale").when(attempts <= most, "scheduled").otherwise("gave_up")
    out = rows.select(key, attempts.cast("int").alias("attempts"), F.col(version).alias("version"), outcome.alias("outcome"))
    due = F.when(F.col("outcome") == "scheduled", F.timestamp_seconds(F.unix_timestamp(now) + F.col("attempts") * step))
    return out.withColumn("due", due).select(key, "attempts", "version", "due", "outcome")


def resync_needed(events: DataFrame, path: str, ts: str, buffer: int = 256, window: str = "500 milliseconds") -> DataFrame:
    """(began, reason): when the whole tree must be compared again: a rule file changed, or more events came within a window than the buffer holds."""
    rules = events.where(F.col(path).rlike(r"(^|/)\.gitignore$")).groupBy(F.session_window(ts, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("began"), F.lit("rules").alias("reason"))
    many = events.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > buffer).select(F.col("w.start").alias("began"), F.lit("overflow").alias("reason"))
    return rules.unionByName(many)


#: What may follow each state of the index.
STATES = {"starting": ("indexing",), "indexing": ("ready", "degraded"), "ready": ("indexing", "degraded"), "degraded": ("indexing", "ready")}


@dataclass
class IndexState:
    """The state of the index: it serves when ready or degraded."""

    state: str = "starting"
    message: str = ""

    def move(self, state: str, message: str = "") -> None:
        if state != self.state and state not in STATES[self.state]:
            raise ValueError(f"{self.state} is not followed by {state}")
        self.state, self.message = state, message.strip()

    @property
    def servable(self) -> bool:
        return self.state in ("ready", "degraded")


@dataclass
class Resync:
    """At most one comparison runs and one waits: requests during a run are one."""

    run: Callable[[], None]
    running: bool = False
    pending: bool = False

    def request(self) -> None:
        if self.running:
            self.pending = True
            return
        self.running = True
        try:
            while True:
                self.pending = False
                self.run()
                if not self.pending:
                    return
        finally:
            self.running = False


@dataclass
class Maintenance:
    """Tasks that are due at intervals, in seconds."""

    tasks: dict[str, tuple[float, Callable[[], None]]]
    done: dict[str, float] = field(default_factory=dict)

    def tick(self, now: float) -> list[str]:
        """Runs and names what is due."""
        due = [n for n, (every, _) in self.tasks.items() if now - self.done.setdefault(n, now) >= every]
        for n in due:
            self.tasks[n][1]()
            self.done[n] = now
        return due


def apply_stream(events: DataFrame, key: str, ts: str, tie: str, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands the latest event of each key of every micro-batch to `apply`, until the source has no more."""
    return events.writeStream.foreachBatch(lambda df, i: apply(latest(df, key, ts, tie), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
