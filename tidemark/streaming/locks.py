"""Lock forecasts before outcomes arrive and score them after, as a keyed stream.

One stateful operator per ledger. Its input is the union of outcomes, heartbeats,
observations and control rows, keyed by series (``messages``); a micro-batch plays the
role of one poll. State per series is small: running counts, the open lock, the last
few signatures. Time comes from the rows, so a replay gives the same ledger.

Rows reach the operator packed, those of a series and an Arrow batch as one, and stay columns
there; outcomes are learned from a batch at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter, namedtuple
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_EVEN, Decimal
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import columns as C
from tidemark.operators.logistic import ChallengerConfig
from tidemark.schemas import STREAM_LEDGER
from tidemark.streaming.history import Points, challenged

PLACES = Decimal("0.000001")
SEQUENCE = 32
MISSES = 8
MIN_COHORT, STRENGTH = 6, 20
GATE_MIN, GATE_WINDOW, GATE_SKILL = 16, 60, Decimal(5)

# kind: outcome, heartbeat, observation, signatures
MESSAGE = (
    "series string, kind string, us bigint, id string, value string, session string, "
    "ready boolean, signature string, direction string, payload_format string, "
    "payload_bytes bigint, scores string"
)
COLUMNS = [part.split()[0] for part in MESSAGE.split(", ")]
FIELDS = [part.split()[0] for part in STREAM_LEDGER.split(", ")]
STATE = "body string"

#: Control rows first; an observation at an outcome's instant belongs before it.
KINDS = pa.array(["signatures", "heartbeat", "observation", "outcome"])

#: Outcomes whose texts are objects at once.
STEP = 65_536

ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
TABLE = pa.schema([(n, ARROW[t]) for n, t in (part.split() for part in MESSAGE.split(", "))])
Message = namedtuple("Message", COLUMNS)

#: Columns that a table of messages has; of the others, those that are not null throughout.
ALWAYS = ["kind", "us", "id", "value"]

#: Rows of one series: the names of their columns, and these as Arrow's bytes, compressed.
PACKED = "series string, names string, size bigint, rows binary"


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each series of a batch as one."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).cast(TABLE).combine_chunks()
        if not len(table):
            continue
        codes = table["series"].combine_chunks().dictionary_encode()
        order = np.argsort(pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        codes = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)[order]
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        made: dict[str, list] = {n: [] for n in ("series", "names", "size", "rows")}
        for lo, hi in zip(edges, edges[1:]):
            own = table.slice(lo, hi - lo)
            names = [n for n in COLUMNS[1:] if n in ALWAYS or own[n].null_count < len(own)]
            body = own.select(names).to_batches()[0].serialize()
            made["series"].append(own["series"][0].as_py())
            made["names"].append(",".join(names))
            made["size"].append(body.size)
            made["rows"].append(pa.compress(body, codec="lz4", asbytes=True))
        yield pa.RecordBatch.from_pydict(made, pa.schema([("series", pa.string()), ("names", pa.string()), ("size", pa.int64()), ("rows", pa.binary())]))


def unpacked(rows: Iterator[pd.DataFrame]) -> pa.Table:
    """The messages of a series, packed or not."""
    parts = [TABLE.empty_table().select(ALWAYS)]
    for some in rows:
        if "rows" not in some.columns:
            parts.append(pa.Table.from_pandas(some[COLUMNS], TABLE, preserve_index=False))
            continue
        for names, size, body in zip(some["names"], some["size"], some["rows"]):
            schema = pa.schema([TABLE.field(n) for n in names.split(",")])
            parts.append(pa.Table.from_batches([pa.ipc.read_record_batch(pa.decompress(body, int(size), "lz4"), schema)]))
    return pa.concat_tables(parts, promote_options="default").combine_chunks()


def messages(
    outcomes: DataFrame | None = None,
    heartbeats: DataFrame | None = None,
    observations: DataFrame | None = None,
    signatures: DataFrame | None = None,
) -> DataFrame:
    """The keyed union the stateful operators read; any side may be missing."""
    parts = []
    if outcomes is not None:
        parts.append(
            outcomes.select(
                "series", F.lit("outcome").alias("kind"), C.micros("ts").alias("us"),
                F.col("outcome_id").alias("id"), F.col("value").cast("string").alias("value"),
            )
        )
    if heartbeats is not None:
        parts.append(
            heartbeats.select(
                "series", F.lit("heartbeat").alias("kind"), C.micros("ts").alias("us"),
                F.col("collector_session_id").alias("session"),
                F.coalesce("capture_ready", F.lit(True)).alias("ready"),
            )
        )
    if observations is not None:
        parts.append(
            observations.select(
                "series", F.lit("observation").alias("kind"), C.micros("ts").alias("us"),
                F.col("obs_id").alias("id"), C.observation_signature().alias("signature"),
                "direction", "payload_format", "payload_bytes",
            )
        )
    if signatures is not None:
        parts.append(
            signatures.select(
                "series", F.lit("signatures").alias("kind"), C.micros("ts").alias("us"), "scores",
                *(["id"] if "id" in signatures.columns else []),
            )
        )
    columns = [part.split() for part in MESSAGE.split(", ")]
    union = None
    for part in parts:
        full = part.select(
            *[
                (F.col(n) if n in part.columns else F.lit(None)).cast(t).alias(n)
                for n, t in columns
            ]
        )
        union = full if union is None else union.unionByName(full)
    return union


def _quotient(top: int | Decimal, bottom: int) -> str:
    return str((Decimal(top) / Decimal(bottom)).quantize(PLACES, rounding=ROUND_HALF_EVEN))


def _places(value: float | None) -> str | None:
    return None if value is None else str(Decimal(str(value)).quantize(PLACES, rounding=ROUND_HALF_EVEN))


def messages_of(rows: pa.Table) -> list[Message]:
    made: list[Message] = []
    for batch in rows.to_batches():
        held = batch.to_pydict()
        made += map(Message._make, zip(*(held.get(n, repeat(None)) for n in COLUMNS)))
    return made


def message(rows: pa.Table, at: int) -> Message:
    return messages_of(rows.slice(at % len(rows), 1))[0]


def of_kind(rows: pa.Table, kind: str) -> pa.Table:
    """Without a copy where all rows are of it."""
    found = pc.equal(rows["kind"], kind)
    return rows if pc.all(found, min_count=0, skip_nulls=False).as_py() else rows.filter(found)


def _equal(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Nulls are equal to one another."""
    same = pc.fill_null(pc.equal(left, right), False).to_numpy(zero_copy_only=False)
    return same | (pc.is_null(left).to_numpy(zero_copy_only=False) & pc.is_null(right).to_numpy(zero_copy_only=False))


def _id(prefix: str, *parts: object) -> str:
    material = "|".join(str(p) for p in parts)
    return prefix + hashlib.sha256(material.encode()).hexdigest()[:24]


class _Ledger(StatefulProcessor):
    """What both ledgers share: counts of the history, sessions, numbered events."""

    def __init__(self, thresholds: Sequence[str], min_history: int, stale_seconds: float, sessions: bool, event_time: bool):
        self.event_time = event_time
        self.thresholds = [str(t) for t in thresholds]
        self.limits = [Decimal(str(t)) for t in thresholds]
        self.min_history = min_history
        self.stale_ms = int(stale_seconds * 1000)
        self.sessions = sessions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("state", STATE)

    def load(self) -> dict:
        found = self.cell.get() if self.cell.exists() else None
        if found is not None:
            return json.loads(found[0])
        return {
            "seq": 0, "n": 0, "hits": [0] * len(self.limits), "last": None, "lock": None,
            "session": None, "armed": None, "beat": None,
        }

    def save(self, state: dict) -> None:
        self.cell.update((json.dumps(state),))

    def event(self, state: dict, kind: str, us: int, **values) -> dict:
        row = dict.fromkeys(FIELDS)
        row.update(event=kind, seq=state["seq"], us=int(us), collector_session_id=state["session"], **values)
        state["seq"] += 1
        return row

    def prior(self, state: dict, minimum: int | None = None) -> dict[str, str | None]:
        if state["n"] < (self.min_history if minimum is None else minimum):
            return dict.fromkeys(self.thresholds)
        return {t: _quotient(h, state["n"]) for t, h in zip(self.thresholds, state["hits"])}

    def briers(self, probabilities: dict, value: str) -> dict[str, str]:
        made = {}
        for text, p in probabilities.items():
            if p is not None:
                miss = Decimal(p) - (Decimal(value) >= Decimal(text))
                made[text] = str((miss * miss).quantize(PLACES, rounding=ROUND_HALF_EVEN))
        return made

    def close_lock(self, state: dict, us: int, reason: str) -> list[dict]:
        lock, state["lock"] = state["lock"], None
        if lock is None:
            return []
        return [self.event(state, self.INVALIDATED, us, lock_id=lock["id"], reason=reason)]

    def arm(self, state: dict, us: int) -> dict:
        state["armed"] = state["n"]
        last = state["last"][0] if state["last"] else None
        return self.event(
            state, self.ARMED, us, history_count=state["n"], reference_id=last,
            reason="await_fresh_outcome",
        )

    def beat(self, state: dict, row, timers) -> list[dict]:
        """A heartbeat: a new session or a collector that is not ready closes the lock."""
        if not self.sessions:
            return []
        session = row.session if row.ready else None
        state["beat"] = int(row.us)
        now = int(row.us) // 1000 + 1 if self.event_time else timers.getCurrentProcessingTimeInMs()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if session is not None:
            self.handle.registerTimer(now + self.stale_ms)
        if session == state["session"]:
            return []
        reason = "collector_session_changed" if session else "collector_heartbeat_missing_or_stale"
        events = self.close_lock(state, row.us, reason)
        state["session"] = session
        self.forget(state)
        if session is not None:
            events.append(self.arm(state, row.us))
        return events

    def forget(self, state: dict) -> None:
        state["armed"] = None

    def due(self, state: dict) -> int | None:
        """When the session is stale, by the time of its last heartbeat."""
        return state["beat"] + self.stale_ms * 1000 if state["session"] is not None else None

    def expire(self, state: dict, us: int) -> list[dict]:
        events = self.close_lock(state, us, "collector_heartbeat_missing_or_stale")
        state["session"] = None
        self.forget(state)
        return events

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.load()
        us = state["last"][1] if state["last"] else 0
        if self.event_time:
            us = self.due(state)
            if us is None or expiredTimerInfo.getExpiryTimeInMs() * 1000 < us:
                return
        events = self.expire(state, us)
        self.save(state)
        yield self.frame(key, events)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = unpacked(rows)
        # Control rows first, then by time. By event time, heartbeats have their place in time too.
        rank = pc.index_in(batch["kind"], KINDS)
        late = pc.fill_null(pc.greater_equal(rank, 1 if self.event_time else 2), False)
        keys = pa.table({"late": late.cast(pa.int8()), "us": batch["us"], "rank": rank, "id": batch["id"]}).combine_chunks()
        batch = batch.take(pc.sort_indices(keys, sort_keys=[(n, "ascending") for n in keys.column_names]))
        state = self.load()
        batch, events = self.fresh(state, batch)
        events += self.in_time(state, batch, timerValues) if self.event_time else self.advance(state, self.taken(batch), timerValues)
        self.save(state)
        yield self.frame(key, events)

    def taken(self, rows: pa.Table):
        """The rows as ``advance`` takes them."""
        return messages_of(rows)

    def in_time(self, state: dict, rows: pa.Table, timers) -> list[dict]:
        """Rows in their order in time, a stale session ended where it became so, however rows come in batches."""
        events, start = [], 0
        beats = pc.equal(rows["kind"], "heartbeat").to_pylist()
        for i, us in enumerate(rows["us"].to_pylist()):
            due = self.due(state)
            stale = due is not None and us is not None and us > due
            if stale or beats[i]:
                events += self.advance(state, self.taken(rows.slice(start, i - start)), timers)
                start = i
            if stale:
                events += self.expire(state, due)
            if beats[i]:
                events += self.advance(state, self.taken(rows.slice(i, 1)), timers)
                start = i + 1
        return events + self.advance(state, self.taken(rows.slice(start)), timers)

    def fresh(self, state: dict, rows: pa.Table) -> tuple[pa.Table, list[dict]]:
        """The rows without outcomes that are replayed or late, and an event that counts these.

        An outcome counts only behind the last one, by time and then id: an earlier one is
        in no forecast's future, and its own reference outcome must not score a lock.
        """
        at = np.flatnonzero(pc.fill_null(pc.equal(rows["kind"], "outcome"), False).to_numpy())
        if not len(at):
            return rows, []
        found = of_kind(rows, "outcome")
        if found["us"].null_count:
            raise ValueError("an outcome has no time.")
        us, ids = found["us"].to_numpy(), found["id"].combine_chunks()
        # Outcomes are in order, so replays of one another are neighbours.
        ignored = np.zeros(len(us), bool)
        ignored[1:] = (us[1:] == us[:-1]) & _equal(ids[1:], ids[:-1])
        if state["last"]:
            last_id, last_us = state["last"]
            ignored |= us < last_us
            for i in np.flatnonzero((us == last_us) & ~ignored):
                ignored[i] = (last_us, ids[i].as_py()) <= (last_us, last_id)
        if not ignored.any():
            return rows, []
        of = int(np.flatnonzero(ignored)[-1])
        kept = np.ones(len(rows), bool)
        kept[at[ignored]] = False
        return rows.filter(pa.array(kept)), [
            self.event(
                state, "outcomes_ignored", state["last"][1] if state["last"] else us[of],
                unpredicted=int(ignored.sum()), history_count=state["n"],
                reference_id=state["last"][0] if state["last"] else None, actual_id=ids[of].as_py(),
                reason="replayed_or_late_outcome",
            )
        ]

    def frame(self, key, events: list[dict]) -> pd.DataFrame:
        made = pd.DataFrame(events, columns=FIELDS, dtype=object)
        made["series"] = key[0]
        return made

    def close(self) -> None:
        pass


class ForecastLocks(_Ledger):
    """Score the open lock with the first new outcome, note the others as a gap, lock again.

    A lock has the frequency of each threshold, over all outcomes or the last ``window``, the
    challenger's say on it, and the point forecast with its interval. With sessions, nothing
    is locked until one outcome has arrived after arming.
    """

    ARMED, INVALIDATED = "prediction_armed", "prediction_invalidated"

    def __init__(self, thresholds, min_history, stale_seconds, sessions, event_time, window: int | None, challenger: ChallengerConfig | None, point: bool):
        super().__init__(thresholds, min_history, stale_seconds, sessions, event_time)
        if window is not None and window < min_history:
            raise ValueError("rolling window cannot be smaller than min_history.")
        self.window, self.challenger, self.point = window, challenger, point

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        if self.challenger:
            # Values that came before they were kept in blocks.
            self.values = handle.getListState("values", "value double")
            self.blocks = handle.getListState("blocks", "block binary")

    def taken(self, rows: pa.Table) -> pa.Table:
        return rows

    def learn(self, state: dict, rows: pa.Table) -> None:
        """From outcomes in their order, some at a time."""
        points = Points(state.get("points")) if self.point else None
        for at in range(0, len(rows), STEP):
            texts = rows["value"].slice(at, STEP).to_numpy()
            values = np.array([float(v) for v in texts])
            if np.isnan(values).any():
                raise ValueError("an outcome's value is no number.")
            state["n"] += len(values)
            state["hits"] = [h + self.wins(texts, values, t) for h, t in zip(state["hits"], self.limits)]
            if self.window is not None:
                state["last_values"] = [*state.get("last_values", []), *texts[-self.window :]][-self.window :]
            if self.point:
                points.learn(values)
            if self.challenger:
                self.blocks.appendValue((values.astype("<f8").tobytes(),))
        last = message(rows, -1)
        state["last"] = [last.id, last.us]
        if self.point:
            state["points"] = points.state

    @staticmethod
    def wins(texts: np.ndarray, values: np.ndarray, limit: Decimal) -> int:
        """How many decimals reach the limit; those that are equal to it as doubles are compared as decimals."""
        near = texts[values == float(limit)]
        return int((values > float(limit)).sum()) + sum(n for v, n in Counter(near).items() if Decimal(v) >= limit)

    def history(self, state: dict) -> np.ndarray:
        """All values so far; as zeros, while they are too few to be read."""
        if state["n"] < self.challenger.min_history:
            return np.zeros(state["n"])
        before = np.array([r[0] for r in self.values.get()], float)
        return np.concatenate([before, np.frombuffer(b"".join(r[0] for r in self.blocks.get()), "<f8")])

    def prior(self, state: dict, minimum: int | None = None) -> dict[str, str | None]:
        if self.window is None:
            return super().prior(state, minimum)
        last = [Decimal(v) for v in state.get("last_values", [])]
        if len(last) < (self.min_history if minimum is None else minimum):
            return dict.fromkeys(self.thresholds)
        return {t: _quotient(sum(v >= limit for v in last), len(last)) for t, limit in zip(self.thresholds, self.limits)}

    def forecast(self, state: dict) -> dict:
        """Columns of a lock: probabilities, details, point forecast."""
        prior = self.prior(state)
        made = {"probabilities": prior, "status": "READY" if None not in prior.values() else "INSUFFICIENT_DATA"}
        if self.challenger:
            order = sorted(range(len(self.limits)), key=lambda k: self.limits[k])
            base = [None if prior[t] is None else float(prior[t]) for t in self.thresholds]
            rows = challenged("", self.history(state), [base[k] for k in order], [float(self.limits[k]) for k in order], self.challenger)
            names = [self.thresholds[k] for k in order]
            made["probabilities"] = {t: _places(r["probability"]) for t, r in zip(names, rows)}
            made["details"] = {
                t: {
                    "source": r["source"], "reason": r["reason"], "baseline_probability": _places(r["baseline_probability"]),
                    "raw_candidate_probability": _places(r["raw_candidate_probability"]), "selected_c": r["selected_c"],
                    "candidate_skill_pct": r["candidate_skill_pct"], "candidate_weight": r["candidate_weight"],
                }
                for t, r in zip(names, rows)
            }
        if self.point:
            point = Points(state.get("points")).forecast()
            shown = {n: None if point[n] is None else f"{point[n]:.2f}" for n in ("predicted", "lower", "upper")}
            made["predicted"] = shown["predicted"]
            made["interval"] = None if shown["lower"] is None else {"lower": shown["lower"], "upper": shown["upper"]}
            made["point"] = json.dumps({n: v for n, v in point.items() if n not in shown}, sort_keys=True)
        return made

    def point_score(self, lock: dict, value: str) -> dict | None:
        if lock.get("predicted") is None:
            return None
        actual = Decimal(value)
        error = abs(Decimal(lock["predicted"]) - actual).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN)
        low, high = (Decimal(lock["interval"][n]) for n in ("lower", "upper"))
        return {
            "absolute_error": str(error), "relative_error": str((error / actual).quantize(PLACES, rounding=ROUND_HALF_EVEN)),
            "within_interval": low <= actual <= high,
        }

    def advance(self, state: dict, rows: pa.Table, timers) -> list[dict]:
        events: list[dict] = []
        fresh = of_kind(rows, "outcome")
        if self.sessions:
            for row in messages_of(of_kind(rows, "heartbeat")):
                events += self.beat(state, row, timers)
        if not len(fresh):
            return events
        lock = state["lock"]
        self.learn(state, fresh)
        if lock is not None:
            first, last = message(fresh, 0), message(fresh, -1)
            events.append(
                self.event(
                    state, "prediction_scored", first.us, lock_id=lock["id"], actual_id=first.id,
                    actual_value=first.value, probabilities=lock["p"],
                    briers=self.briers(lock["p"], first.value), point_score=self.point_score(lock, first.value),
                )
            )
            state["lock"] = None
            if len(fresh) > 1:
                events.append(
                    self.event(
                        state, "prediction_gap", last.us, lock_id=lock["id"],
                        unpredicted=len(fresh) - 1, reference_id=message(fresh, 1).id, actual_id=last.id,
                        reason="multiple_outcomes_before_next_lock",
                    )
                )
        elif self.sessions:
            if state["session"] is None or state["armed"] is None or state["n"] <= state["armed"]:
                return events
        last_id, us = state["last"]
        made = self.forecast(state)
        lock = {
            "id": _id("lock-", state["n"], last_id, us), "p": made["probabilities"],
            "predicted": made.get("predicted"), "interval": made.get("interval"),
        }
        state["lock"] = lock
        events.append(
            self.event(
                state, "prediction_locked", us, lock_id=lock["id"], history_count=state["n"],
                reference_id=last_id, **made,
            )
        )
        return events


class TriggerLocks(_Ledger):
    """Lock a snapshot at the first frozen signature of an interval; score or miss it.

    Frozen signatures arrive as ``signatures`` rows and may be replaced at any time.
    Of an interval only its totals and last signatures are kept.
    """

    ARMED, INVALIDATED = "prospective_capture_armed", "pre_round_snapshot_invalidated"

    def __init__(self, thresholds, stale_seconds: float, sessions: bool, event_time: bool, min_age_seconds: float):
        super().__init__(thresholds, 1, stale_seconds, sessions, event_time)
        self.min_age_us = C.to_micros(min_age_seconds)

    def load(self) -> dict:
        state = super().load()
        state.setdefault("frozen", {})
        state.setdefault("previous", None)
        state.setdefault("interval", None)
        state.setdefault("misses", 0)
        state.setdefault("controls", {})
        state.setdefault("cohorts", {"": self.empty()})
        return state

    def empty(self) -> dict:
        """A cohort: scored locks, hits and the last losses per threshold."""
        return {"n": 0, "hits": [0] * len(self.limits), "losses": []}

    def forget(self, state: dict) -> None:
        state["armed"], state["previous"], state["interval"] = None, None, None

    def learn(self, state: dict, row) -> None:
        value = Decimal(row.value)
        state["n"] += 1
        state["hits"] = [h + (value >= t) for h, t in zip(state["hits"], self.limits)]
        state["last"] = [row.id, int(row.us)]

    def open(self, state: dict, row) -> list[dict]:
        """A boundary: the interval begins, and its prior forecast is published."""
        state["previous"] = [row.id, int(row.us)]
        state["armed"] = None
        state["interval"] = {
            "n": 0, "received": 0, "sent": 0, "binary": 0, "bytes": 0, "seen": [], "at": int(row.us),
        }
        return [
            self.event(state, "prospective_boundary_ready", row.us, reference_id=row.id),
            self.event(
                state, "pre_round_prior_forecast", row.us, reference_id=row.id,
                history_count=state["n"], probabilities=self.prior(state, 1),
            ),
        ]

    def advance(self, state: dict, rows: list, timers) -> list[dict]:
        events: list[dict] = []
        fresh_left = sum(r.kind == "outcome" for r in rows)
        for row in rows:
            if row.kind == "signatures":
                if not self.is_new(state, row.id):
                    continue
                refreshed = bool(state["frozen"])
                state["frozen"] = json.loads(row.scores)
                if refreshed:
                    events.append(
                        self.event(
                            state, "trigger_regime_refreshed", row.us,
                            history_count=len(state["frozen"]), reason="consecutive_trigger_misses",
                        )
                    )
            elif row.kind == "heartbeat":
                events += self.beat(state, row, timers)
            elif row.kind == "observation":
                events += self.observe(state, row)
            else:
                fresh_left -= 1
                self.learn(state, row)
                events += self.complete(state, row, fresh_left)
        return events

    def is_new(self, state: dict, control) -> bool:
        """Whether control rows of this id, or later ones of its query, have not been applied.

        A batch that is run again answers a refresh again; its rows have the same id.
        """
        if not isinstance(control, str):
            return True
        query, _, batch = control.rpartition(":")
        if int(batch) <= state["controls"].get(query, -1):
            return False
        state["controls"][query] = int(batch)
        return True

    def complete(self, state: dict, row, more: int) -> list[dict]:
        lock = state["lock"]
        if state.get("together"):  # others of the batch that scored a lock: arm over all
            state["together"] = more > 0
            return [] if more else [self.arm(state, row.us)]
        if lock is not None:
            self.settle(state, lock, row.value)
            state["lock"], state["misses"] = None, 0
            scored = self.event(
                state, "pre_round_snapshot_scored", row.us, lock_id=lock["id"], actual_id=row.id,
                actual_value=row.value, probabilities=lock["p"],
                briers=self.briers(lock["p"], row.value),
            )
            if more:  # results arrived together: wait for a fresh one
                state["previous"], state["interval"], state["together"] = None, None, True
                return [scored]
            return [scored, *self.open(state, row)]
        if state["previous"] is not None:
            events = [
                self.event(
                    state, "pre_round_snapshot_missed", row.us, reference_id=state["previous"][0],
                    actual_id=row.id, actual_value=row.value,
                    reason="no_frozen_trigger_before_next_outcome",
                )
            ]
            state["misses"] += 1
            if state["misses"] >= MISSES:
                state["misses"] = 0
                events.append(self.event(state, "trigger_refresh_wanted", row.us))
            return events + self.open(state, row)
        if self.sessions and (state["session"] is None or state["armed"] is None):
            return []
        if more:
            return [self.arm(state, row.us)] if self.sessions else []
        return self.open(state, row)

    def observe(self, state: dict, row) -> list[dict]:
        interval, previous = state["interval"], state["previous"]
        if interval is None or row.us <= previous[1] or state["lock"] is not None:
            return []
        gap = max(0, int(row.us) - interval["at"]) / 1000.0
        interval["seen"] = [*interval["seen"], [row.signature, round(gap, 3)]][-SEQUENCE:]
        interval["at"] = int(row.us)
        interval["n"] += 1
        interval["received"] += row.direction == "received"
        interval["sent"] += row.direction == "sent"
        interval["binary"] += row.payload_format == "binary"
        interval["bytes"] += int(row.payload_bytes)
        age = int(row.us) - previous[1]
        score = state["frozen"].get(row.signature)
        if score is None or age < self.min_age_us:
            return []
        prior = self.prior(state, 1)
        cohort = state["cohorts"].get(row.signature)
        if cohort is None or cohort["n"] < MIN_COHORT:
            cohort = state["cohorts"][""]
        candidate = {
            t: _quotient(Decimal(prior[t]) * STRENGTH + hits, STRENGTH + cohort["n"])
            for t, hits in zip(self.thresholds, cohort["hits"])
        }
        chosen = self.gate(cohort["losses"], prior, candidate)
        lock = {
            "id": _id("snapshot-", state["session"], previous[0], row.us, row.signature),
            "p": chosen, "prior": prior, "candidate": candidate, "trigger": row.signature,
        }
        state["lock"], state["misses"] = lock, 0
        names = [s for s, _ in interval["seen"]]
        features = {
            "event_count_since_previous": interval["n"],
            "received_count": interval["received"],
            "sent_count": interval["sent"],
            "binary_count": interval["binary"],
            "total_payload_bytes": interval["bytes"],
            "signature_counts": dict(pd.Series(names).value_counts()),
            "transition_counts": dict(pd.Series([f"{a} -> {b}" for a, b in zip(names, names[1:])], dtype=object).value_counts()),
            "recent_sequence": [{"signature": s, "gap_ms": g} for s, g in interval["seen"]],
        }
        return [
            self.event(
                state, "pre_round_snapshot_locked", row.us, lock_id=lock["id"],
                reference_id=previous[0], history_count=state["n"], probabilities=chosen,
                historical_probabilities=prior, candidate_probabilities=candidate, trigger_signature=row.signature,
                trigger_score=float(score), trigger_age_seconds=age / 1e6,
                features=json.dumps(features, default=int, sort_keys=True),
            )
        ]

    def gate(self, losses: list, prior: dict, candidate: dict) -> dict[str, str]:
        """The candidate where it has beaten the prior by 5 percent on the cohort's last
        locks, else the prior; never rising with the threshold."""
        chosen, ceiling = {}, Decimal(1)
        for k, t in enumerate(self.thresholds):
            value = Decimal(prior[t])
            if len(losses) >= GATE_MIN:
                mine, base = (sum(Decimal(row[k][side]) for row in losses) for side in (0, 1))
                if base > 0 and (base - mine) / base * 100 >= GATE_SKILL:
                    value = Decimal(candidate[t])
            ceiling = min(ceiling, value)
            chosen[t] = str(ceiling)
        return chosen

    def settle(self, state: dict, lock: dict, value: str) -> None:
        """Count a scored lock in its trigger's cohort and in the one of all."""
        won = [int(Decimal(value) >= t) for t in self.limits]
        losses = [
            [str((Decimal(lock[side][t]) - w) ** 2) for side in ("candidate", "prior")]
            for t, w in zip(self.thresholds, won)
        ]
        for name in ("", lock["trigger"]):
            cohort = state["cohorts"].setdefault(name, self.empty())
            cohort["n"] += 1
            cohort["hits"] = [h + w for h, w in zip(cohort["hits"], won)]
            cohort["losses"] = [*cohort["losses"], losses][-GATE_WINDOW:]


def _run(stream: DataFrame, processor: _Ledger, delay: str | None) -> DataFrame:
    # Timers watch heartbeats; without sessions a replay ends when its input does.
    mode = "None"
    if processor.sessions:
        mode = "EventTime" if processor.event_time else "ProcessingTime"
    if mode == "EventTime":
        stream = stream.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    else:  # the watermark looks at single rows
        stream = stream.select(*COLUMNS).mapInArrow(pack, PACKED)
    return stream.groupBy("series").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=STREAM_LEDGER, outputMode="append", timeMode=mode
    )


def lock_and_score(
    stream: DataFrame,
    thresholds: Sequence[str] = ("1.5", "2", "5"),
    min_history: int = 50,
    sessions: bool = False,
    stale_seconds: float = 5.0,
    window: int | None = None,
    challenger: ChallengerConfig | None = ChallengerConfig(),
    point: bool = True,
    watermark: str | None = None,
) -> DataFrame:
    """Forecast ledger events of a stream of ``messages``. Needs the RocksDB state store.

    ``window`` makes the frequencies rolling. The challenger keeps all values of a series in
    state, and is fitted to them at each lock; without it, the state of a series is bounded.

    Sessions become stale by the wall clock, or, with ``watermark`` (how late rows may be), by the
    rows' own time: then a replay ends them at the same rows, in whatever batches they come.
    """
    processor = ForecastLocks(thresholds, min_history, stale_seconds, sessions, watermark is not None, window, challenger, point)
    return _run(stream, processor, watermark)


def trigger_locks(
    stream: DataFrame,
    thresholds: Sequence[str] = ("1.5", "2", "5"),
    sessions: bool = False,
    stale_seconds: float = 5.0,
    min_age_seconds: float = 1.0,
    watermark: str | None = None,
) -> DataFrame:
    """Snapshot ledger events of a stream of ``messages``. Needs the RocksDB state store.

    ``watermark`` as in ``lock_and_score``.
    """
    return _run(stream, TriggerLocks(thresholds, stale_seconds, sessions, watermark is not None, min_age_seconds), watermark)


CONTROL = "series string, ts timestamp, scores string, id string"


def stream_signatures(spark: SparkSession, control_path: str) -> DataFrame:
    """The signatures that refreshes have written, for ``messages``."""
    return spark.readStream.schema(CONTROL).option("recursiveFileLookup", "true").json(control_path)


def refresh_sink(ledger_path: str, control_path: str, discover):
    """foreachBatch function: append the ledger, and answer wanted refreshes.

    ``discover()`` reruns trigger discovery on the stored tables and returns one row
    per series with ``scores`` (JSON of signature to score); the rows of the series
    that asked are written to the control folder the stream reads. They carry the query and
    the number of the batch: one that is run again replaces what it wrote, and the state
    applies rows of an id once, whether or not it had read the first ones.
    """
    from tidemark.streaming.ingest import ledger_sink

    append = ledger_sink(ledger_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        append(batch, batch_id)
        wanted = batch.where(F.col("event") == "trigger_refresh_wanted").groupBy("series").agg(
            F.max("us").alias("us")
        )
        if wanted.isEmpty():
            return
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        found = discover().join(wanted, "series").select(
            "series", F.timestamp_micros("us").alias("ts"), "scores", F.lit(f"{query_id}:{batch_id}").alias("id")
        )
        found.write.mode("overwrite").json(f"{control_path}/{query_id}-{batch_id}")

    return write


def score_map(signatures: DataFrame) -> DataFrame:
    """Frozen signatures as one JSON object of scores per series."""
    pairs = F.map_from_entries(F.collect_list(F.struct("signature", "score")))
    return signatures.groupBy("series").agg(F.to_json(pairs).alias("scores"))
