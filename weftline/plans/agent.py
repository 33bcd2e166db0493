"""A bounded agent loop over an injected chat model and a gated registry of functions; turns are audited as rows."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from weftline.operators.security import PUBLIC
from weftline.plans.schema import callable_spec

COMPLETED, TOOL_CALL, TOOL_ERROR, ERROR = "COMPLETED", "TOOL_CALL_RESPONSE", "TOOL_ERROR", "ERROR"
#: messages, tools -> {"content": str | None, "tool_calls": [...], "finish_reason": str, "usage": {...}}
ChatModel = Callable[[list[dict], list[dict]], dict]


@dataclass
class Tool:
    spec: dict
    call: Callable[..., Any]
    level: int = PUBLIC


class Functions:
    """Callables by name. A caller may use those whose level admits his; no level means the system, which may use all."""

    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def add(self, f: Callable[..., Any], name: str | None = None, level: int = PUBLIC, spec: dict | None = None) -> None:
        s = {**(spec or callable_spec(f)), **({"name": name} if name else {})}
        self.tools[s["name"]] = Tool(s, f, level)

    def visible(self, level: int | None = None, names: list[str] | None = None) -> list[dict]:
        return [t.spec for n, t in self.tools.items() if (level is None or level <= t.level) and (names is None or n in names)]

    def evaluate(self, call: dict, level: int | None = None) -> Any:
        """Runs one call {"function": {"name", "arguments"}}; unknown and forbidden functions are errors."""
        f = call.get("function") or call
        tool = self.tools.get(f.get("name", ""))
        if tool is None:
            raise KeyError(f"no function {f.get('name')!r}")
        if level is not None and level > tool.level:
            raise PermissionError(f"{f['name']} needs level {tool.level}")
        args = f.get("arguments") or {}
        return tool.call(**(json.loads(args) if isinstance(args, str) else args))


@dataclass
class Turn:
    session_id: str
    ordinal: int
    role: str
    content: str | None
    tool_calls: str | None = None
    tool_eval_data: str | None = None
    status: str = COMPLETED
    tokens_in: int = 0
    tokens_out: int = 0
    function_stack: list[str] = field(default_factory=list)


def run(question: str, model: ChatModel, functions: Functions, session_id: str = "s", limit: int = 3, level: int | None = None, prompt: str = "") -> Iterator[Turn]:
    """Turns of a conversation until the model completes or ``limit`` model calls were made."""
    messages = [{"role": "system", "content": prompt}] if prompt else []
    messages.append({"role": "user", "content": question})
    stack: list[str] = []
    n = 0
    yield Turn(session_id, n, "user", question)
    for _ in range(limit):
        n += 1
        try:
            r = model(messages, functions.visible(level))
        except Exception as x:
            yield Turn(session_id, n, "assistant", str(x), status=ERROR, function_stack=list(stack))
            return
        calls, usage = r.get("tool_calls") or [], r.get("usage") or {}
        status = COMPLETED if not calls or r.get("finish_reason") in ("stop", "end_turn") else TOOL_CALL
        results = []
        if status == TOOL_CALL:
            messages.append({"role": "assistant", "content": r.get("content"), "tool_calls": calls})
            for c in calls:
                name = (c.get("function") or c).get("name")
                if name not in stack:
                    stack.append(name)
                try:
                    data = functions.evaluate(c, level)
                except Exception as x:
                    data, status = {"error": str(x)}, TOOL_ERROR
                results.append({"id": c.get("id") or name, "data": data})
                messages.append({"role": "tool", "tool_call_id": c.get("id") or name, "content": json.dumps(data, default=str)})
        yield Turn(session_id, n, "assistant", r.get("content"), json.dumps(calls) if calls else None, json.dumps(results, default=str) if results else None, status, usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), list(stack))
        if status == COMPLETED:
            return


def plan(question: str, model: ChatModel, functions: Functions, session_id: str = "s", level: int | None = None, prompt: str = "") -> Turn:
    """The model's answer to how it would go about a question: it is shown what functions there are, and calls none."""
    known = "\n".join(json.dumps({k: f.get(k) for k in ("name", "description")}, ensure_ascii=False) for f in functions.visible(level))
    messages = [{"role": "system", "content": prompt}] if prompt else []
    messages += [{"role": "user", "content": f"Functions that may be used:\n{known}"}, {"role": "user", "content": question}]
    try:
        r = model(messages, [])
    except Exception as x:
        return Turn(session_id, 1, "assistant", str(x), status=ERROR)
    usage = r.get("usage") or {}
    return Turn(session_id, 1, "assistant", r.get("content"), tokens_in=usage.get("prompt_tokens", 0), tokens_out=usage.get("completion_tokens", 0))


def resume(state: str, model: ChatModel, functions: Functions, session_id: str, limit: int = 3, level: int | None = None) -> Iterator[Turn]:
    """Goes on with a session from its canonical messages (``messages`` of ``conversation_state``); nothing to answer gives no turn."""
    past = [{"role": m.get("role"), "content": m.get("content")} for m in json.loads(state) if m.get("content")]
    asked = next((i for i in range(len(past) - 1, -1, -1) if past[i]["role"] == "user"), None)
    if asked is None:
        return
    told = past[:asked] + past[asked + 1 :]
    again = lambda messages, tools: model([*told, *messages], tools)
    turns = run(past[asked]["content"], again, functions, session_id, limit, level)
    next(turns)  # the question is in the session already
    yield from turns


def add_native(functions: Functions, engine: Any, model: ChatModel | None = None, level: int = PUBLIC, rows: int = 20) -> set[str]:
    """Adds the five built-in functions over an engine; the set returned holds the names activated so far. Lists are at most ``rows`` long."""
    active: set[str] = set()
    shown = lambda df: [r.asDict(recursive=True) for r in df.limit(rows).collect()]

    def get_entities(keys: list[str]) -> dict:
        """Rows of all entities with one of these keys."""
        return {name: shown(df) for name, df in engine.get_entities(keys).items()}

    def search(question: str, entity_table_name: str) -> dict:
        """Rows of an entity that answer a question."""
        a = engine.entity(entity_table_name).search(question)
        return {"query_text": a.query_text, "confidence": a.confidence, "relational": shown(a.relational) if a.relational is not None else [], "vector": shown(a.vector) if a.vector is not None else [], "errors": a.errors}

    def help(question: str) -> str | None:
        """How a question could be gone about with the functions there are."""
        return plan(question, model, functions).content if model else "\n".join(sorted(functions.tools))

    def announce_generate_large_output(estimated_length: int) -> dict:
        """Tells that a long answer follows."""
        return {"message": "acknowledged", "estimated_length": estimated_length}

    def activate_functions_by_name(function_names: list[str]) -> list[str]:
        """Makes functions available by name."""
        active.update(n for n in function_names if n in functions.tools)
        return sorted(active)

    for f in (help, get_entities, search, announce_generate_large_output, activate_functions_by_name):
        functions.add(f, level=level)
    return active


class Cache:
    """Least recently used entries with a time to live and a hit rate; for models and other things the driver keeps."""

    def __init__(self, size: int = 100, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.items: OrderedDict[Any, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        now = self.clock()
        found = self.items.get(key)
        if found and now - found[0] < self.ttl:
            self.items.move_to_end(key)
            self.hits += 1
            return found[1]
        self.misses += 1
        value = make()
        self.items[key] = (now, value)
        self.items.move_to_end(key)
        while len(self.items) > self.size:
            self.items.popitem(last=False)
        return value

    @property
    def hit_rate(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0


def voice_segments(energy_db: list[float], frame: float = 0.01, threshold: float = -35.0, silence: float = 0.5, shortest: float = 0.25) -> list[tuple[float, float]]:
    """Speech in a row of frame energies: opened above the threshold, closed by ``silence`` seconds below it; the whole row if none."""
    out: list[tuple[float, float]] = []
    start = last = None
    for i, e in enumerate(energy_db):
        if e > threshold:
            start = i if start is None else start
            last = i
        elif start is not None and (i - last) * frame >= silence:
            out.append((start * frame, (last + 1) * frame))
            start = None
    if start is not None:
        out.append((start * frame, (last + 1) * frame))
    kept = [(round(a, 6), round(b, 6)) for a, b in out if b - a >= shortest - 1e-9]
    return kept or [(0.0, round(len(energy_db) * frame, 6))]
