"""State machines over the events of one key. Each is a pure step: (state, event) gives (state, rows out).

The same step serves a batch (groups sorted by time) and a stream (state kept between micro-batches), so both give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Machine:
    """name; step(state, event) -> (state, rows); start() -> state; output columns (DDL); the event's columns."""

    name: str
    start: Callable[[], dict]
    step: Callable[[dict, dict], tuple[dict, list[dict]]]
    output: str
    columns: tuple[str, ...] = ("kind", "text")


def _turn_step(state: dict, e: dict) -> tuple[dict, list[dict]]:
    """Turns of a call. Events: user_started, user_stopped, final, text, llm, audio, interrupted, finished.

    A user who starts to speak opens a turn, also while the last answer still plays; stages count once a turn, the first time.
    An interruption ends a turn's answer unless a new turn is open already.
    """
    out = []

    def stage(name):
        if name not in state["stages"]:
            state["stages"][name] = e["at"]
            since = state["stages"].get("user_stopped", state["opened"])
            out.append({"turn": state["turn"], "stage": name, "mode": state["mode"], "ms": max(0.0, float(e["at"] - since))})

    def open_turn(mode):
        state.update(turn=state["turn"] + 1, mode=mode, speaking=mode == "voice", identity=True, opened=e["at"], stages={}, active=False)

    k = e["kind"]
    if k == "user_started" and not state["speaking"]:
        open_turn("voice")
        stage("user_started")
    elif k == "user_stopped":
        if not state["speaking"] and not state["active"]:
            open_turn("voice")
        stage("user_stopped")
        state["speaking"] = False
    elif k in ("final", "text"):
        if state["active"] and "audio" in state["stages"]:
            state.update(active=False, identity=False)
        if not state["identity"]:
            open_turn("text" if k == "text" else "voice")
            state["speaking"] = False
        state["active"] = True
        stage("final")
    elif k in ("llm", "audio") and state["active"]:
        stage(k)
    elif k == "interrupted" and not state["speaking"] or k == "finished":
        if state["identity"]:
            stage("cancelled" if k == "interrupted" else "finished")
        state.update(active=False, speaking=False, identity=False)
    return state, out


TURNS = Machine(
    "turns",
    lambda: {"turn": 0, "mode": "voice", "speaking": False, "identity": False, "active": False, "opened": 0, "stages": {}},
    _turn_step,
    "turn long, stage string, mode string, ms double",
)


def rate_limit(most: int = 8, seconds: int = 60) -> Machine:
    """accepted for each attempt: fewer than `most` accepted ones in the last `seconds`. Rejected attempts don't count; one of exactly that age doesn't, either."""

    def step(state, e):
        recent = [t for t in state["at"] if e["at"] - t < seconds * 1000]
        ok = len(recent) < most
        state["at"] = recent + [e["at"]] * ok
        return state, [{"event_id": e["id"], "accepted": ok}]

    return Machine("rate_limit", lambda: {"at": []}, step, "event_id long, accepted boolean")


def message_chunks(size: int = 8) -> Machine:
    """Every run of `size` messages, if its last is the assistant's."""

    def step(state, e):
        state["held"].append([e["kind"], e["text"] or ""])
        state["first"] = state["first"] if len(state["held"]) > 1 else e["at"]
        if len(state["held"]) < size:
            return state, []
        held, state["held"] = state["held"], []
        text = "\n".join(f"{k}: {t}" for k, t in held)
        return state, [{"start": state["first"], "end": e["at"], "text": text}] if held[-1][0] == "assistant" else []

    return Machine("message_chunks", lambda: {"held": [], "first": 0}, step, "start long, end long, text string")


def terminal(ended: tuple[str, ...] = ("completed", "failed", "abandoned", "cancelled")) -> Machine:
    """accepted for each event: what comes after a call's end is rejected."""

    def step(state, e):
        ok = not state["ended"]
        state["ended"] = state["ended"] or e["kind"] in ended
        return state, [{"event_id": e["id"], "accepted": ok}]

    return Machine("terminal", lambda: {"ended": False}, step, "event_id long, accepted boolean")


def segments(first: int = 40, later: int = 160, markers: tuple[str, ...] = ("<|", "[[")) -> Machine:
    """Speakable pieces of streamed text deltas: whole sentences, the first piece short for a quick start, later ones longer.

    Text stays back while its end could be the beginning of a marker; from a whole marker on, the response is dropped. kind `end` flushes.
    """
    sentence = re.compile(r"[.!?]+(?=\s)|\n")

    def step(state, e):
        out = []
        end = e["kind"] == "end"
        if not state["blocked"]:
            state["held"] += e["text"] or ""
            cut = min((i for m in markers if (i := state["held"].find(m)) >= 0), default=-1)
            if cut >= 0:
                state.update(held=state["held"][:cut], blocked=True)
        keep = 0
        if not end and not state["blocked"]:
            keep = max((n for m in markers for n in range(1, len(m)) if state["held"].endswith(m[:n])), default=0)
        while True:
            ready = state["held"][: len(state["held"]) - keep]
            goal = later if state["n"] else first
            ends = [m.end() for m in sentence.finditer(ready)]
            at = next((x for x in ends if x >= goal), None)
            if at is None and (end or state["blocked"]):
                at = len(ready) or None
            if at is None and len(ready) > 2 * goal:
                at = ready.rfind(" ", 0, 2 * goal) + 1 or 2 * goal
            if at is None:
                break
            piece, state["held"] = state["held"][:at].strip(), state["held"][at:]
            if piece:
                out.append({"n": state["n"], "text": piece})
                state["n"] += 1
        if end:
            state.update(held="", n=0, blocked=False)
        return state, out

    return Machine("segments", lambda: {"held": "", "n": 0, "blocked": False}, step, "n long, text string")


def breaker(most: int = 3, seconds: int = 30) -> Machine:
    """The circuit's state after each outcome (ok, failed): opens after `most` failures in a row, half open once `seconds` have passed."""

    def step(state, e):
        if state["open_at"] is not None and e["at"] - state["open_at"] >= seconds * 1000:
            state["half"] = True
        if e["kind"] == "ok":
            state.update(failures=0, open_at=None, half=False)
        else:
            state["failures"] += 1
            if state["failures"] >= most or state["half"]:
                state.update(open_at=e["at"], half=False)
        return state, [{"event_id": e["id"], "circuit": "closed" if state["open_at"] is None else "open"}]

    return Machine("breaker", lambda: {"failures": 0, "open_at": None, "half": False}, step, "event_id long, circuit string")


def drafts(required: tuple[str, ...]) -> Machine:
    """A form that a conversation fills: the draft's number and status after each event, what is missing, and whether it was written.

    Events: start; one of the required names with a text (an empty one takes the field back); confirm; cancel. A draft is written by a confirmation
    only, and only while nothing is missing; whatever is said after a confirmation or cancellation but a start is ignored.
    """

    def step(state, e):
        k, written = e["kind"], False
        if k == "start" and state["status"] in ("idle", "written", "cancelled"):
            state.update(n=state["n"] + 1, status="collecting", fields={})
        elif state["status"] in ("collecting", "review"):
            if k in required:
                fields = {**state["fields"], k: (e["text"] or "").strip()}
                state["fields"] = {f: v for f, v in fields.items() if v}
                state["status"] = "review" if set(required) <= set(state["fields"]) else "collecting"
            elif k == "cancel":
                state["status"] = "cancelled"
            elif k == "confirm" and state["status"] == "review":
                state["status"], written = "written", True
        missing = [f for f in required if f not in state["fields"]] if state["status"] in ("collecting", "review") else []
        return state, [{"event_id": e["id"], "draft": state["n"], "status": state["status"], "missing": ",".join(missing), "written": written}]

    return Machine("drafts", lambda: {"n": 0, "status": "idle", "fields": {}}, step, "event_id long, draft long, status string, missing string, written boolean")
