"""Streaming twins of the stateful operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_stream(blocks: DataFrame, least_chars: int = 160, ttl: str = "14 days") -> DataFrame:
    """Repeats of earlier blocks of a trajectory: traj_id, turn_idx, pos, handle, is_repeat, first_turn.

    State holds each handle's first turn and the digest of its text, so a repeat is told from a
    collision; it is dropped after ttl without a block. Blocks: traj_id, turn_idx, pos, stability, text.
    """
    out = "traj_id long, turn_idx long, pos long, handle string, is_repeat boolean, first_turn long"
    millis = {"days": 86_400_000, "hours": 3_600_000}[ttl.split()[1]] * int(ttl.split()[0])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        handles, turns_, digests = (list(x) for x in state.get) if state.exists else ([], [], [])
        seen = dict(zip(handles, zip(turns_, digests, strict=True), strict=True))
        rows = []
        for r in pd.concat(list(batches)).sort_values(["turn_idx", "pos"]).itertuples():
            first = None
            if r.stability == "volatile" and "DECISION:" not in r.text and len(r.text) >= least_chars:
                known = seen.setdefault(r.handle, (None, r.digest))
                if known[0] is None:
                    seen[r.handle] = (int(r.turn_idx), r.digest)
                elif known[1] == r.digest:
                    first = known[0]
            rows.append((key[0], r.turn_idx, r.pos, r.handle, first is not None, first))
        state.update(([*seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]))
        state.setTimeoutDuration(millis)
        frame = pd.DataFrame(rows, columns=["traj_id", "turn_idx", "pos", "handle", "is_repeat", "first_turn"])
        yield frame.astype({"first_turn": "Int64"})

    b = blocks.withColumn("digest", F.sha2("text", 256)).withColumn("handle", F.substring("digest", 1, 8))
    return b.groupBy("traj_id").applyInPandasWithState(step, out, "handles array<string>, turns array<long>, digests array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drift_stream(losses: DataFrame, alpha: float = 0.05, delta: float = 0.05, most: float = 0.5) -> DataFrame:
    """The drift monitor by key, over an unbounded stream of (key, seq, loss): key, n, capital, tripped after each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, squares, var, capital, tripped = state.get if state.exists else (0, 0.0, 0.0, 0.25, 1.0, False)
        for x in pd.concat(list(batches)).sort_values("seq")["loss"]:
            if tripped:
                break
            n += 1
            capital *= 1 + min(most, math.sqrt(2 * math.log(1 / delta) / (var * n))) * (x - alpha)
            total += x
            squares += (x - (0.5 + total) / (n + 1)) ** 2
            var, tripped = (0.25 + squares) / (n + 1), capital >= 1 / delta
        state.update((n, float(total), float(squares), float(var), float(capital), bool(tripped)))
        yield pd.DataFrame([(key[0], n, capital, tripped)], columns=["key", "n", "capital", "tripped"])

    return losses.groupBy("key").applyInPandasWithState(step, "key string, n long, capital double, tripped boolean", "n long, total double, squares double, var double, capital double, tripped boolean", "update", GroupStateTimeout.NoTimeout)


def tenant_totals(requests: DataFrame) -> DataFrame:
    """Running totals by tenant, for update mode."""
    return requests.groupBy("tenant").agg(F.count("*").alias("requests"), F.sum("tokens_baseline").alias("tokens_baseline"), F.sum("tokens_compressed").alias("tokens_compressed"))


def shadow_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "equivalent").count()


def savings_windows(requests: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tokens saved in tumbling windows (an addition of ours); in a stream rows later than `late` are dropped."""
    w = requests.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return w.agg(F.count("*").alias("requests"), F.sum("saved").alias("saved")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "saved")


def activity_sessions(requests: DataFrame, gap: str = "4 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key's activity with gaps below `gap` (an addition of ours)."""
    w = requests.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("requests")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def session_delta(messages: DataFrame) -> DataFrame:
    """Per request of a session how far it repeats the one before: session, request, messages, prefix (equal leading messages), fresh.

    State holds the hashes of the newest request's messages and no content. messages: session,
    request, pos, text. Requests of one batch are taken in order; an older one than the newest seen
    is held against it too, and doesn't replace it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, known = state.get if state.exists else (-1, [])
        rows = []
        for request, part in pd.concat(list(batches)).sort_values(["request", "pos"]).groupby("request"):
            hashes = part["h"].tolist()
            n = next((i for i, (a, b) in enumerate(zip(hashes, known)) if a != b), min(len(hashes), len(known)))
            rows.append((key[0], int(request), len(hashes), n, len(hashes) - n))
            if request > newest:
                newest, known = int(request), hashes
        state.update((newest, list(known)))
        yield pd.DataFrame(rows, columns=["session", "request", "messages", "prefix", "fresh"])

    m = messages.withColumn("h", F.sha2("text", 256))
    return m.groupBy("session").applyInPandasWithState(step, "session string, request long, messages long, prefix long, fresh long", "newest long, known array<string>", "append", GroupStateTimeout.NoTimeout)


def savings_flush(requests: DataFrame, every: int = 10, age: str = "30 seconds") -> DataFrame:
    """Savings by model given out after `every` requests or `age` since the first one waiting: model, requests, before, after.

    requests: model, before, after. What waits lies in the state; a group that saved nothing is
    dropped when its turn comes.
    """
    millis = int(age.split()[0]) * {"seconds": 1000, "minutes": 60_000}[age.split()[1]]
    columns = ["model", "requests", "before", "after"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, before, after = state.get if state.exists else (0, 0, 0)
        late = state.hasTimedOut
        out = []
        if not late:
            for r in pd.concat(list(batches)).itertuples():
                n, before, after = n + 1, before + int(r.before), after + int(r.after)
                if n >= every:
                    out.append((key[0], n, before, after))
                    n = before = after = 0
        elif n:
            out.append((key[0], n, before, after))
            n = before = after = 0
        if n:
            state.update((n, before, after))
            state.setTimeoutDuration(millis)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([r for r in out if r[2] > r[3]], columns=columns).astype({c: "int64" for c in columns[1:]})

    return requests.groupBy("model").applyInPandasWithState(step, "model string, requests long, before long, after long", "n long, before long, after long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sampled(requests: DataFrame, rate: float, key: str = "request_id") -> DataFrame:
    """The share `rate` of requests, by a hash of their key: the same ones in every run and on every executor."""
    return requests.where(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0 < rate)
