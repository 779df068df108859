"""From syntax trees to one record a test: what is counted in its body, and where it stands."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .lexer import SyntaxProblem
from .parser import Node, parse

# Names that the measures look for.
ASSERTION = re.compile(r"(assert|expect)", re.I)
CONTAINER_MOCKS = {"mock", "partialMock", "spy", "instance"}
NATIVE_MOCKS = {"createMock", "createStub", "createPartialMock", "getMockBuilder"}
MOCKERY_MOCKS = {"mock", "spy", "namedMock"}
FAKED_FACADES = {"Http", "Queue", "Event", "Storage", "Mail", "Bus", "Notification", "Cache", "Log"}
HTTP_CALLS = {"get", "getJson", "post", "postJson", "put", "putJson", "patch", "patchJson", "delete", "deleteJson", "options", "head", "call", "json"}
DB_ASSERTIONS = {"assertDatabaseHas", "assertDatabaseMissing", "assertDatabaseCount"}
SETUP = ("factory", "create", "make")
CALLS = ("call", "nullcall", "staticcall", "func")
CLOSURE_BASE = "PestTestCase"
NO_DESCRIPTION = "(anonymous)"


def simple(name: object) -> str:
    return str(name).rpartition("\\")[2]


def call_name(node: Node) -> str | None:
    """The name called, without namespace; null if it is computed."""
    return None if node.name is None else simple(node.name)


def receiver_class(node: Node) -> str | None:
    of = node.parts.get("of")
    return simple(of.name) if of is not None and of.kind == "name" else None


def on_this(node: Node) -> bool:
    of = node.parts.get("of")
    return of is not None and of.kind == "var" and of.name == "this"


def class_arguments(node: Node) -> Iterator[str]:
    """Classes named by arguments of the form Name::CONSTANT."""
    for arg in node.parts.get("args", ()):
        value = arg.parts.get("value")
        if arg.kind == "arg" and value is not None and value.kind == "classfetch" and (found := receiver_class(value)) is not None:
            yield found


def nodes(body: list[Node]) -> list[Node]:
    return [n for top in body for n in top.walk()]


def measure(body: list[Node]) -> dict:
    """Counts and facts of one test's statements."""
    every = nodes(body)
    calls = [n for n in every if n.kind in CALLS]
    methods = [n for n in calls if n.kind == "call"]
    statics = [n for n in calls if n.kind == "staticcall"]
    # A fluent chain is walked outward: which call is made on this call's result.
    outer = {id(n.parts["of"]): n for n in methods if n.parts["of"].kind == "call"}

    def chain(n: Node) -> int:
        depth = 1
        while (n := outer.get(id(n))) is not None:
            depth += 1
        return depth

    mocks = []
    for n in methods:
        kind = None
        if on_this(n):
            kind = "container" if n.name in CONTAINER_MOCKS else "phpunit_native" if n.name in NATIVE_MOCKS else None
        if kind:
            mocks.append({"kind": kind, "target": next(class_arguments(n), None), "chain_depth": chain(n)})
    for n in statics:
        cls = receiver_class(n)
        if cls == "Mockery" and n.name in MOCKERY_MOCKS:
            mocks.append({"kind": "mockery", "target": next(class_arguments(n), None), "chain_depth": 1})
        elif cls in FAKED_FACADES and n.name == "fake":
            mocks.append({"kind": "facade_fake", "target": cls, "chain_depth": 1})
    signals: dict[str, int] = {}
    for n in calls:
        if n.kind in ("call", "staticcall") and n.name in SETUP:
            signals[n.name] = signals.get(n.name, 0) + 1
    return {
        "assertion_count": sum(1 for n in calls if (name := call_name(n)) is not None and ASSERTION.match(name)),
        "mocks": mocks,
        "size_statements": sum(n.stmt for n in every),
        "setup_signals": signals,
        "has_http": any(on_this(n) and n.name in HTTP_CALLS for n in methods),
        "has_factory": any(n.name == "factory" for n in statics),
        "has_db_assert": any(n.name in DB_ASSERTIONS for n in methods),
    }


def _record(identifier: str, owner: Node, body: list[Node], front_end: str, base: str, traits: list[str]) -> dict:
    return {
        "identifier": identifier, "front_end": front_end, "base_class": base, "traits": traits,
        "size_loc": max(1, owner.end - owner.line + 1), "start_line": owner.line or None, "end_line": owner.end or None,
    } | measure(body)


def is_test(method: Node) -> bool:
    marked = any(simple(a.name) == "Test" for a in method.parts.get("attrs", ()))
    return str(method.name).startswith("test") or marked or "@test" in (method.parts.get("doc") or "")


def class_tests(tree: Node) -> list[dict] | None:
    """Tests of the first class that extends another; null if there is none."""
    owner = next((n for n in tree.walk() if n.kind == "class" and n.parts.get("extends") is not None), None)
    if owner is None:
        return None
    traits = [simple(name.name) for m in owner.parts["members"] if m.kind == "traituse" for name in m.parts["names"]]
    base = simple(owner.parts["extends"].name)
    methods = [n for m in owner.parts["members"] for n in m.walk() if n.kind == "method"]
    return [_record(str(n.name), n, n.parts.get("body", []), "phpunit", base, traits) for n in methods if is_test(n)]


def closure_tests(tree: Node) -> list[dict]:
    """Tests given as closures to it() or test(), at any depth."""
    calls = [n for n in tree.walk() if n.kind == "func" and n.name is not None]
    traits = [c for n in calls if simple(n.name) == "uses" for c in class_arguments(n)]
    out = []
    for n in calls:
        if simple(n.name) not in ("it", "test"):
            continue
        values = [a.parts["value"] for a in n.parts["args"] if a.kind == "arg"]
        closures = [v for v in values if v.kind in ("closure", "arrow")]
        if closures:
            described = next((str(v.name) for v in values if v.kind == "string"), NO_DESCRIPTION)
            owner = closures[-1]
            out.append(_record(described, owner, owner.parts.get("body", []), "pest", CLOSURE_BASE, traits))
    return out


def read_file(source: str, front_end: str) -> tuple[list[dict] | None, str | None]:
    """(tests, problem): null tests where no class qualifies; a problem if the text isn't valid."""
    try:
        tree = parse(source)
        return (closure_tests(tree) if front_end == "pest" else class_tests(tree)), None
    except SyntaxProblem as e:
        return None, str(e)
    except RecursionError:
        return None, "Syntax error, nested too deeply"
