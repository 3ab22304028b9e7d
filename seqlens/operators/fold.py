"""What is carried from event to event of a trajectory, as a state that parts of the trajectory can pass on.

A trajectory is cut into parts by step. `summary` says what a part does to any state it may start with: a table of 12 entries for
phase and first edit, counts, first uses of names, what becomes of the context; such summaries compose. The walk of uncertainty
is clamped and in IEEE order: where walks from 0 and from 1 meet inside the part, its end is known; else its ups and downs go along
and are walked once more from the value at the cut. `walk` then folds each part from its own start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa

# Phases, label pools and amounts.
PHASES = ("exploration", "hypothesis", "implementation", "validation", "debugging", "initial")
POOL = 26
TOKENS_MAX, TOKENS_A_COMMAND = 200_000, 150
READ, ERROR = -0.04, 0.08
FILES = ("file_read", "file_edit")

#: What the fold reads of an event: `name` is the path, the error's class or the command's first word.
READS = ("type", "outcome", "from_phase", "to_phase", "name", "tokens_used", "tokens_max")


def moves(kind: str, passed: bool, named: tuple[str | None, str | None], phase: str, edited: bool) -> tuple[str, str]:
    """(phase left, phase entered) at an event."""
    if kind == "file_edit":
        return phase, "implementation" if not edited or phase not in ("implementation", "debugging") else phase
    if kind == "test_run":
        return phase, "validation" if passed else "debugging"
    if kind == "task_transition":
        source, target = (x if x in PHASES else other for x, other in zip(named, (phase, "exploration"), strict=True))
        if source != target:
            return source, target
        return phase, "hypothesis" if phase == "exploration" else "exploration"
    return phase, phase


def emitted(kind: str, passed: bool, left: str) -> int:
    """Constraints of an event, but for the one of a context that runs out."""
    if kind == "test_run":
        return 1 + (left != "validation") if passed else 2 + (left != "debugging")
    return int(kind in ("bash_call", "context_update", "error_reveal", "task_transition", *FILES))


def step_up(u: float, kind: str) -> float:
    return max(0.0, u + READ) if kind == "file_read" else min(1.0, u + ERROR) if kind == "error_reveal" else u


def is_low(used: int, most: int) -> bool:
    """Below a fifth once rounded to thousandths."""
    return max(0.0, 1.0 - used / most) < 0.1995


@dataclass
class State:
    seq: int = 0
    place: int = 0
    phase: str = "exploration"
    edited: bool = False
    u: float = 0.5
    used: int = 0
    most: int = TOKENS_MAX
    ran_out: bool = False
    fails: int = 0
    errors: int = 0
    command: int = -1
    n_files: int = 0
    files: dict = field(default_factory=dict)
    commands: dict = field(default_factory=dict)
    error_names: dict = field(default_factory=dict)

    def file(self, name: str | None) -> int:
        """Number of a file by first use; one without a name is a new one each time."""
        number = self.files.get(name) if name else None
        if number is None:
            number = self.n_files
            self.n_files += 1
            if name:
                self.files[name] = number
        return number

    def after(self, part: Summary) -> State:
        """The state at the part's end, had it started with this one."""
        at = PHASES.index(self.phase) * 2 + self.edited
        to = part.table[at]
        out = replace(self, files=self.files, commands=dict(self.commands), error_names=dict(self.error_names))
        out.seq, out.place = self.seq + part.n, self.place + part.made[at]
        out.phase, out.edited = PHASES[to // 2], bool(to % 2)
        out.u = part.u_low
        if part.u_low != part.u_high:
            out.u = self.u
            for up in part.path:
                out.u = step_up(out.u, "error_reveal" if up else "file_read")
        if part.calls:
            out.used = min(self.used + TOKENS_A_COMMAND * part.calls, self.most)
        low = bool(part.calls) and is_low(out.used, self.most) or part.low
        if low and not self.ran_out:
            out.ran_out, out.place = True, out.place + 1
        if part.used is not None:
            out.used, out.most = part.used, part.most
        out.fails, out.errors = self.fails + part.fails, self.errors + part.errors
        for name in part.files:
            out.file(name)
        for known, names in ((out.commands, part.commands), (out.error_names, part.error_names)):
            for name in names:
                number(known, name)
        if part.last_command is not None:
            out.command = number(out.commands, part.last_command)
        return out


def number(known: dict, name: str) -> int:
    """Of a command or an error's class by first use, the last of the pool for all beyond; these need not be kept."""
    if name in known:
        return known[name]
    if len(known) < POOL:
        known[name] = len(known)
        return known[name]
    return POOL - 1


@dataclass
class Summary:
    n: int = 0
    table: list = field(default_factory=lambda: list(range(12)))
    made: list = field(default_factory=lambda: [0] * 12)
    u_low: float = 0.0
    u_high: float = 1.0
    path: bytes = b""
    calls: int = 0
    used: int | None = None
    most: int | None = None
    low: bool = False
    fails: int = 0
    errors: int = 0
    files: list = field(default_factory=list)
    commands: list = field(default_factory=list)
    error_names: list = field(default_factory=list)
    last_command: str | None = None


def summary(events: Iterator[tuple]) -> Summary:
    """Of the events of a part in order, each as READS."""
    s, path = Summary(), bytearray()
    met: dict = {"files": set(), "commands": {}, "error_names": {}}
    effects: dict = {}
    for kind, outcome, source, target, name, used, most in events:
        s.n += 1
        passed = outcome == "pass"
        effect = effects.get((kind, passed, source, target))
        if effect is None:
            effect = []
            for state in range(12):
                phase, edited = PHASES[state // 2], bool(state % 2)
                left, new = moves(kind, passed, (source, target), phase, edited)
                effect.append((PHASES.index(new) * 2 + (edited or kind == "file_edit"), emitted(kind, passed, left)))
            effects[kind, passed, source, target] = effect
        s.made = [m + effect[t][1] for m, t in zip(s.made, s.table, strict=True)]
        s.table = [effect[t][0] for t in s.table]
        if kind in ("file_read", "error_reveal") and s.u_low != s.u_high:
            path.append(kind == "error_reveal")
        s.u_low, s.u_high = step_up(s.u_low, kind), step_up(s.u_high, kind)
        if kind in FILES:
            if not name or name not in met["files"]:
                met["files"].add(name)
                s.files.append(name or None)
        elif kind == "bash_call":
            number(met["commands"], name)
            s.last_command = name
            if s.used is None:
                s.calls += 1
            else:
                s.used = min(s.used + TOKENS_A_COMMAND, s.most)
        elif kind == "error_reveal":
            s.errors += 1
            number(met["error_names"], name)
        elif kind == "test_run":
            s.fails += not passed
        elif kind == "context_update":
            s.used, s.most = used or 0, max(most or TOKENS_MAX, 1)
        if s.used is not None and kind in ("bash_call", "context_update"):
            s.low = s.low or is_low(s.used, s.most)
    s.path = bytes(path) if s.u_low != s.u_high else b""
    s.commands, s.error_names = list(met["commands"]), list(met["error_names"])
    return s


ADDED = "seq long, place long, left string, edited boolean, phase string, u double, number int, cmd int, used long, most long, runs_out boolean, fails long, errors long"
_ADDED_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())


def walk(state: State, events: Iterator[tuple]) -> Iterator[tuple]:
    """For each event in order what ADDED names; the state moves along. `place` is the first constraint's place in the chain."""
    for kind, outcome, source, target, name, used, most in events:
        passed = outcome == "pass"
        state.seq += 1
        left, phase = moves(kind, passed, (source, target), state.phase, state.edited)
        state.u = step_up(state.u, kind)
        label, runs_out = None, False
        if kind in FILES:
            label = state.file(name)
        elif kind == "error_reveal":
            label = number(state.error_names, name)
            state.errors += 1
        elif kind == "bash_call":
            state.command = number(state.commands, name)
            state.used = min(state.used + TOKENS_A_COMMAND, state.most)
        elif kind == "test_run":
            state.fails += not passed
        elif kind == "context_update":
            state.used, state.most = used or 0, max(most or TOKENS_MAX, 1)
        if kind in ("bash_call", "context_update") and not state.ran_out and is_low(state.used, state.most):
            state.ran_out = runs_out = True
        yield (
            state.seq, state.place, left, state.edited, phase, state.u, label, max(state.command, 0),
            state.used, state.most, runs_out, state.fails, state.errors,
        )
        state.place += emitted(kind, passed, left) + runs_out
        state.phase, state.edited = phase, state.edited or kind == "file_edit"


# --- on Arrow tables ------------------------------------------------------------------------------------------------------

SUMMARY_FIELDS = (
    "n long, table array<int>, made array<long>, u_low double, u_high double, path binary, calls long, used long, most long, low boolean, fails long,"
    " errors long, files array<string>, commands array<string>, error_names array<string>, last_command string"
)
START_FIELDS = (
    "seq long, place long, phase string, edited boolean, u double, used long, most long, ran_out boolean, fails long, errors long, command int,"
    " n_files long, names array<string>, numbers array<int>, commands array<string>, error_names array<string>"
)
_PA = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _type(name: str) -> pa.DataType:
    return pa.list_(_PA[name[6:-1]]) if name.startswith("array<") else _PA[name]


def _columns(fields: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _type(t)) for n, t in (f.split() for f in fields.split(", "))]


def _read(table: pa.Table) -> Iterator[tuple]:
    return zip(*(table[c].to_pylist() for c in READS), strict=True)


def summarise(part: pa.Table) -> pa.Table:
    """One row (task_id, part, first_step, SUMMARY_FIELDS) of a part's events."""
    part = part.sort_by("step")
    s = summary(_read(part))
    row = part.slice(0, 1).select(["task_id", "part"]).append_column("first_step", part["step"].slice(0, 1).cast(pa.int64()))
    for name, kind in _columns(SUMMARY_FIELDS):
        row = row.append_column(name, pa.array([getattr(s, name)], kind))
    return row


def starts(parts: pa.Table) -> pa.Table:
    """(task_id, part, first_step, START_FIELDS): the state with which each part but the first starts, from a trajectory's summaries. Of the
    names used before, a part is told those it uses itself."""
    parts = parts.sort_by("part")
    rows = [Summary(**{n: r[n] for n, _ in _columns(SUMMARY_FIELDS)}) for r in parts.to_pylist()]
    state, out = State(), []
    for before, s in zip(rows[:-1], rows[1:], strict=True):
        state = state.after(before)
        own = [f for f in s.files if f and f in state.files]
        values = {"names": own, "numbers": [state.files[f] for f in own], "commands": list(state.commands), "error_names": list(state.error_names)}
        out.append([values.get(n, getattr(state, n, None)) for n, _ in _columns(START_FIELDS)])
    table = parts.slice(1).select(["task_id", "part", "first_step"])
    for i, (name, kind) in enumerate(_columns(START_FIELDS)):
        table = table.append_column(name, pa.array([r[i] for r in out], kind))
    return table


def walked(part: pa.Table) -> pa.Table:
    """The part's events with ADDED, from the start that stands beside the first (none: the trajectory's beginning)."""
    part = part.sort_by("step")
    row = part["start"][0].as_py()
    part = part.drop_columns(["start"])
    state = State()
    if row:
        state = State(**{n: row[n] for n, _ in _columns(START_FIELDS) if n not in ("names", "numbers", "commands", "error_names")})
        state.files = dict(zip(row["names"], row["numbers"], strict=True))
        state.commands, state.error_names = ({n: i for i, n in enumerate(row[c])} for c in ("commands", "error_names"))
    columns = list(zip(*walk(state, _read(part)), strict=True)) or [()] * len(_ADDED_TYPES)
    for (name, _), values, kind in zip((f.split() for f in ADDED.split(", ")), columns, _ADDED_TYPES, strict=True):
        part = part.append_column(name, pa.array(values, kind))
    return part
