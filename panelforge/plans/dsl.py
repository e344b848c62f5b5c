"""The formula language: parsing, validation, complexity and canonical form. Nothing is evaluated here."""

from __future__ import annotations

import ast
import hashlib
from dataclasses import dataclass, field

#: Fixed table: operator -> (arguments, place of the window argument or None).
OPERATORS: dict[str, tuple[int, int | None]] = {
    "Add": (2, None), "Sub": (2, None), "Mul": (2, None), "Div": (2, None), "Neg": (1, None),
    "Greater": (2, None), "Less": (2, None), "IfElse": (3, None),
    "TsMean": (2, 1), "TsStd": (2, 1), "TsDelta": (2, 1), "TsRank": (2, 1), "TsCorr": (3, 2), "TsSkew": (2, 1), "TsKurt": (2, 1),
    "CsRank": (1, None),
}
#: Extensions that are off unless asked for.
EXTENSIONS: dict[str, tuple[int, int | None]] = {"TsDelay": (2, 1), "TsAutoCorr": (3, 1)}
COMMUTATIVE = ("Add", "Mul")
#: Fixed list: parts of field names that look into the future.
FUTURE = ("future", "forward", "nextreturn", "next_return", "label", "target")


@dataclass(frozen=True)
class Budget:
    nodes: int = 64
    depth: int = 6
    window: int = 252
    fields: int = 8
    operations: int = 2048
    state_bytes: int = 16 << 20
    flops: int = 4096


@dataclass
class Complexity:
    """``operations`` and ``flops`` are by cell, ``state_bytes`` by security."""

    nodes: int = 0
    calls: int = 0
    depth: int = 0
    window: int = 0
    fields: set[str] = field(default_factory=set)
    operations: int = 0

    @property
    def state_bytes(self) -> int:
        """A double for each field and row of the longest window."""
        return self.window * max(1, len(self.fields)) * 8

    @property
    def flops(self) -> int:
        return self.operations

    def over(self, b: Budget) -> list[str]:
        pairs = [("nodes", self.nodes, b.nodes), ("depth", self.depth, b.depth), ("window", self.window, b.window), ("fields", len(self.fields), b.fields)]
        pairs += [("operations", self.operations, b.operations), ("state_bytes", self.state_bytes, b.state_bytes), ("flops", self.flops, b.flops)]
        return [f"budget_exceeded:{n}:{v}>{most}" for n, v, most in pairs if v > most]


class FormulaError(ValueError):
    def __init__(self, reasons: list[str]):
        super().__init__("; ".join(reasons))
        self.reasons = reasons


def _table(extended: bool) -> dict[str, tuple[int, int | None]]:
    return OPERATORS | EXTENSIONS if extended else OPERATORS


def reasons_against(text: str, fields: set[str], budget: Budget = Budget(), extended: bool = False) -> list[str]:
    """Why a formula is refused; empty if it is fine."""
    known = _table(extended)
    try:
        tree = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError):
        return ["syntax_error"]
    found: list[str] = []

    def visit(node: ast.AST, depth: int) -> None:
        match node:
            case ast.Name(id=name):
                if any(part in name.lower() for part in FUTURE):
                    found.append(f"future_field_forbidden:{name}")
                elif name not in fields:
                    found.append(f"field_not_registered:{name}")
            case ast.Constant(value=value):
                if isinstance(value, bool) or not isinstance(value, int | float):
                    found.append("constant_not_numeric")
            case ast.Call(func=ast.Name(id=name), args=args, keywords=keywords):
                if depth + 1 > budget.depth:
                    found.append(f"call_depth_exceeded:{depth + 1}")
                if keywords:
                    found.append(f"keyword_arguments_forbidden:{name}")
                if name not in known:
                    found.append(f"operator_not_registered:{name}")
                elif len(args) != known[name][0]:
                    found.append(f"wrong_number_of_arguments:{name}:{len(args)}")
                elif (place := known[name][1]) is not None:
                    window = args[place]
                    if not (isinstance(window, ast.Constant) and type(window.value) is int):
                        found.append(f"window_must_be_integer_literal:{name}")
                    elif window.value < 1:
                        found.append(f"window_must_be_positive:{name}:{window.value}")
                    elif window.value > budget.window:
                        found.append(f"window_too_long:{name}:{window.value}")
                for a in args:
                    visit(a, depth + 1)
            case _:
                found.append(f"syntax_node_forbidden:{type(node).__name__}")
                for child in ast.iter_child_nodes(node):
                    if isinstance(child, ast.expr):
                        visit(child, depth)

    visit(tree, 0)
    if isinstance(tree, ast.Constant):
        found.append("result_must_be_a_panel")
    return found or measure(text).over(budget)


def parse(text: str, fields: set[str], budget: Budget = Budget(), extended: bool = False) -> ast.expr:
    if why := reasons_against(text, fields, budget, extended):
        raise FormulaError(why)
    return ast.parse(text, mode="eval").body


def measure(text: str) -> Complexity:
    """Nodes, calls, depth, longest window, fields, and the sum over calls of their windows, 1 without one (twice for operators of second order)."""
    out = Complexity()
    known = _table(True)

    def visit(node: ast.AST, depth: int) -> None:
        if not isinstance(node, ast.expr):
            return
        out.nodes += 1
        if isinstance(node, ast.Name):
            out.fields.add(node.id)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            name = node.func.id
            out.calls += 1
            out.depth = max(out.depth, depth + 1)
            arity, place = known.get(name, (0, None))
            window = node.args[place].value if place is not None and place < len(node.args) and isinstance(node.args[place], ast.Constant) else 1
            if arity and isinstance(window, int):
                out.window = max(out.window, window if place is not None else 0)
                out.operations += max(1, window) * (2 if name in ("TsCorr", "TsSkew", "TsKurt") else 1)
            for a in node.args:
                visit(a, depth + 1)
            return
        for child in ast.iter_child_nodes(node):
            visit(child, depth)

    visit(ast.parse(text, mode="eval").body, 0)
    return out


def canonical(node: ast.expr) -> str:
    """One text for all spellings that mean the same: commutative chains are flattened and sorted."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Constant(value=value):
            return repr(float(value))
        case ast.Call(func=ast.Name(id=name), args=args) if name in COMMUTATIVE:
            terms: list[str] = []
            stack = list(args)
            while stack:
                a = stack.pop()
                if isinstance(a, ast.Call) and isinstance(a.func, ast.Name) and a.func.id == name:
                    stack += a.args
                else:
                    terms.append(canonical(a))
            return f"{name}({','.join(sorted(terms))})"
        case ast.Call(func=ast.Name(id=name), args=args):
            return f"{name}({','.join(map(canonical, args))})"
    raise FormulaError([f"syntax_node_forbidden:{type(node).__name__}"])


def semantic_hash(text: str) -> str:
    return hashlib.sha256(canonical(ast.parse(text, mode="eval").body).encode()).hexdigest()
