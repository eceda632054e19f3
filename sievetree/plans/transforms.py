"""What can be done with a fitted tree besides asking boxes: point likelihoods, conditioning, moments, re-weighting by expectation-maximisation, gradients, simplification, and text forms.

Rows are scored in the tasks that hold them; a model has the size of its tree, so it travels with the task.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dependence as dep
from .tree import Model, Node


def _shares(model: Model, node: Node) -> list[float]:
    own = [float(model.weights.get(c.number, 0)) for c in node.children]
    total = sum(own)
    return [w / total if total else 0.0 for w in own]


def values(model: Model, rows: np.ndarray) -> dict[int, np.ndarray]:
    """For each node the probability of each row's bins; NaN is summed out. Children of a split all model the same rows, so the first stands for it."""
    out: dict[int, np.ndarray] = {}

    def given_box(node: Node, kids: list[np.ndarray]) -> np.ndarray:
        """The value of the box that a row is in; of all boxes its known given values allow, by their rows, where some are NaN."""
        total, mass = np.zeros(len(rows)), np.zeros(len(rows))
        for i, kid in enumerate(kids):
            open_ = np.ones(len(rows), bool)
            for c, (lo, hi) in zip(node.given, node.ranges[i], strict=True):
                x = rows[:, c]
                open_ &= np.isnan(x) | (((x > lo) | (lo == -np.inf)) & (x <= hi))
            w = float(model.weights.get(node.children[1 + i].number, 0))
            total += w * open_ * kid
            mass += w * open_
        return np.divide(total, mass, out=np.zeros(len(rows)), where=mass > 0)

    def fill(node: Node) -> np.ndarray:
        if node.kind == "leaf":
            x, b = rows[:, node.columns[0]], model.bins.get(node.number)
            p = np.zeros(len(rows))
            if b is not None:
                lo, hi, pdf = (np.asarray(b[k]) for k in ("lo", "hi", "pdf"))
                at = np.searchsorted(lo, x, "right") - 1
                hit = (at >= 0) & (x <= hi[np.maximum(at, 0)])
                p = np.where(hit, pdf[np.maximum(at, 0)] * b["non_null"], 0.0)
            found = np.where(np.isnan(x), 1.0, p)
        else:
            kids = [fill(c) for c in node.children]
            if node.kind == "factorize":
                found = kids[0] * given_box(node, kids[1:])
            elif node.kind == "product":
                found = np.prod(kids, axis=0)
            elif node.kind == "split":
                found = kids[0]
            else:
                found = np.einsum("k,kn->n", np.array(_shares(model, node)), np.array(kids))
        out[node.number] = found
        return found

    fill(model.root)
    return out


def likelihood(model: Model, df: DataFrame, given: list[str] | None = None) -> DataFrame:
    """df with `log_likelihood` (natural; -Infinity for a row the model rules out), of all columns, or of the others given those in `given`. NULLs are summed out. df must not have that column."""
    columns, known = model.columns, [model.columns.index(c) for c in given or []]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in dep.batches_to_rows(iter([batch]), columns):
                rows = np.asarray(rows, float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    log = np.log(values(model, rows)[model.root.number])
                    if known:
                        some = np.full_like(rows, np.nan)
                        some[:, known] = rows[:, known]
                        below = np.log(values(model, some)[model.root.number])
                        log = np.where(np.isneginf(below), -np.inf, log - below)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log)], [*batch.schema.names, "log_likelihood"])

    return df.mapInArrow(task, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", log_likelihood double")


def reweigh(model: Model, df: DataFrame, rounds: int = 3) -> Model:
    """Weights of sum nodes by expectation-maximisation: a round is one pass in which each task adds up its rows' responsibilities, then one small exchange. Rows that the model rules out have none; leaves stay as they are."""
    now, columns = model, model.columns
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for _ in range(rounds):
        current = now

        def task(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            sums: dict[int, float] = {}
            for some in dep.batches_to_rows(batches, columns):
                some = np.asarray(some, float)
                value = values(current, some)

                def down(node: Node, share: np.ndarray, value=value) -> None:
                    if node.kind == "sum":
                        with np.errstate(divide="ignore", invalid="ignore"):
                            for child, w in zip(node.children, _shares(current, node), strict=True):
                                own = np.where(value[node.number] > 0, share * w * value[child.number] / value[node.number], 0.0)
                                sums[child.number] = sums.get(child.number, 0.0) + float(own.sum())
                                down(child, own)
                    else:
                        for child in node.children[:1] if node.kind == "split" else node.children:
                            down(child, share)

                down(current.root, (value[current.root.number] > 0).astype(float))
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()))], ["node", "n"])

        found = {r.node: r.n for r in rows.mapInArrow(task, "node int, n double").groupBy("node").agg(F.sum("n").alias("n")).collect()}
        now = Model(model.columns, model.root, model.rows, model.bins, {**now.weights, **found}, model.bounds)
    return now


def condition(model: Model, lo: np.ndarray, hi: np.ndarray) -> Model:
    """The model of the rows inside a box: leaves cut to it, sums re-weighted by how much of each child is inside, `rows` the rows expected there. Raises if none is, and for trees with factorize nodes, whose boxes a cut would part."""
    if any(n.kind == "factorize" for n in model.root.walk()):
        raise ValueError("factorize nodes are not conditioned; ask for probabilities")
    out = Model(model.columns, model.root, model.rows, copy.deepcopy(model.bins), dict(model.weights), model.bounds)

    def cut(node: Node) -> float:
        if node.kind == "leaf":
            c = node.columns[0]
            b = out.bins.get(node.number)
            if not (np.isfinite(lo[c]) or np.isfinite(hi[c])):
                return 1.0
            keep = [] if b is None else [i for i, (a, z) in enumerate(zip(b["lo"], b["hi"], strict=True)) if a <= hi[c] and z >= lo[c]]
            p = sum(b["pdf"][i] for i in keep) if keep else 0.0
            if p <= 0:
                return 0.0
            out.bins[node.number] = {"lo": [b["lo"][i] for i in keep], "hi": [b["hi"][i] for i in keep], "pdf": [b["pdf"][i] / p for i in keep], "non_null": 1.0}
            return p * b["non_null"]
        inside = [cut(c) for c in node.children]
        if node.kind == "product":
            return float(np.prod(inside))
        if node.kind == "split":
            return inside[0]
        shares = _shares(model, node)
        for child, p in zip(node.children, inside, strict=True):
            out.weights[child.number] = model.weights.get(child.number, 0) * p
        return float(sum(w * p for w, p in zip(shares, inside, strict=True)))

    p = cut(model.root)
    if p <= 0:
        raise ValueError("the box has probability 0")
    out.rows = model.rows * p
    return out


def moment(model: Model, column: str, order: int = 1, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> float:
    """E[x^order] of the column's values that are not NULL, inside the box if one is given."""
    own = model if lo is None or hi is None else condition(model, lo, hi)
    c = own.columns.index(column)

    def fold(node: Node) -> tuple[float, float]:
        """(mass that is not NULL, its integral of x^order)."""
        if node.kind == "leaf":
            b = own.bins.get(node.number)
            if b is None:
                return 0.0, 0.0
            x = (np.asarray(b["lo"]) + np.asarray(b["hi"])) / 2
            return b["non_null"], b["non_null"] * float((np.asarray(b["pdf"]) * x**order).sum())
        kids = [k for k in node.children if c in k.columns]
        if node.kind != "sum" and (node.kind != "factorize" or c in node.given):
            return fold(kids[0])
        held = replace(node, children=kids)
        parts = [(w, *fold(k)) for w, k in zip(_shares(own, held), kids, strict=True) if w > 0]
        return sum(w * m for w, m, _ in parts), sum(w * s for w, _, s in parts)

    mass, total = fold(own.root)
    return total / mass if mass else float("nan")


def variance(model: Model, column: str, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> float:
    return moment(model, column, 2, lo, hi) - moment(model, column, 1, lo, hi) ** 2


def gradients(model: Model, row: np.ndarray) -> dict[int, float]:
    """The derivative of a row's probability by each node's value."""
    if any(n.kind == "factorize" for n in model.root.walk()):
        raise ValueError("no gradients of factorize nodes")
    value = {k: float(v[0]) for k, v in values(model, np.asarray(row, float)[None]).items()}
    out = {n.number: 0.0 for n in model.root.walk()}

    def down(node: Node, g: float) -> None:
        out[node.number] += g
        if node.kind == "sum":
            for child, w in zip(node.children, _shares(model, node), strict=True):
                down(child, g * w)
        elif node.kind == "split":
            down(node.children[0], g)
        elif node.kind == "product":
            for i, child in enumerate(node.children):
                down(child, g * float(np.prod([value[o.number] for j, o in enumerate(node.children) if j != i])))

    down(model.root, 1.0)
    return out


def simplified(model: Model) -> Model:
    """Single children take their parent's place and products inside products are joined; answers stay the same. Nodes are numbered anew."""

    def shorter(node: Node) -> tuple[Node, list[tuple[int, int]]]:
        kids = [shorter(c) for c in node.children]
        if len(kids) == 1:
            child, same = kids[0]
            return child, [*same, (node.number, child.number)]
        moved = [m for _, same in kids for m in same]
        children = [k for k, _ in kids]
        if node.kind == "product":
            children = [g for k in children for g in (k.children if k.kind == "product" else [k])]
        return replace(node, children=children), moved

    root, moved = shorter(copy.deepcopy(model.root))
    weights, bounds = dict(model.weights), dict(model.bounds)
    for old, new in moved:
        # A node's own weight and box are those of the rows that reach it; a single child gets the same rows.
        if old in weights:
            weights[new] = weights[old]
        if old in bounds:
            bounds[new] = bounds[old]
    number = {}
    for i, node in enumerate(root.walk()):
        number[node.number] = i
        node.number = i
    again = lambda d: {number[k]: v for k, v in d.items() if k in number}
    return Model(model.columns, root, model.rows, again(model.bins), again(weights), again(bounds))


def factorized_parts(model: Model) -> list[dict]:
    """A row for each leaf behind a factorize node's boxes: the node, its box as intervals of the given columns, the leaf, its column and the box's rows."""
    out = []
    for node in model.root.walk():
        if node.kind == "factorize":
            for child, box in zip(node.children[1:], node.ranges, strict=True):
                out += [{"node": node.number, "box": {model.columns[c]: tuple(b) for c, b in zip(node.given, box, strict=True)}, "leaf": leaf.number, "column": model.columns[leaf.columns[0]], "rows": model.weights.get(child.number, 0)} for leaf in child.walk() if leaf.kind == "leaf"]
    return out


def shared_parts(model: Model) -> dict[int, int]:
    """node -> the first node whose subtree has the same structure and numbers."""
    first: dict[str, int] = {}
    key: dict[int, str] = {}

    def name(node: Node) -> str:
        own = [name(c) for c in node.children]
        b = model.bins.get(node.number) if node.kind == "leaf" else None
        key[node.number] = json.dumps([node.kind, node.columns, node.masks, node.centres, own if node.kind != "sum" else list(zip(_shares(model, node), own, strict=True)), b])
        return key[node.number]

    name(model.root)
    return {n.number: first.setdefault(key[n.number], n.number) for n in model.root.walk()}


def narrowed(root: Node, most: int = 2) -> Node:
    """Products with over `most` children become products of products. The node is numbered anew, so narrow before counting."""
    if most < 2:
        raise ValueError("at least two children")

    def narrow(node: Node) -> Node:
        children = [narrow(c) for c in node.children]
        while node.kind == "product" and len(children) > most:
            groups = [children[i : i + most] for i in range(0, len(children), most)]
            children = [g[0] if len(g) == 1 else Node("product", sorted(c for k in g for c in k.columns), g, node.by) for g in groups]
        return replace(node, children=children)

    out = narrow(root)
    for i, node in enumerate(out.walk()):
        node.number = i
    return out


def to_text(model: Model) -> str:
    """The whole model as JSON."""

    def write(node: Node) -> dict:
        return {"kind": node.kind, "columns": node.columns, "by": node.by, "centres": node.centres, "fill": node.fill, "masks": node.masks, "given": node.given, "ranges": node.ranges, "number": node.number, "weight": model.weights.get(node.number), "bounds": model.bounds.get(node.number), "bins": model.bins.get(node.number), "children": [write(c) for c in node.children]}

    return json.dumps({"columns": model.columns, "rows": model.rows, "root": write(model.root)}, default=lambda x: x.item())


def from_text(text: str) -> Model:
    whole = json.loads(text)
    bins, weights, bounds = {}, {}, {}

    def read(d: dict) -> Node:
        for store, k in ((bins, "bins"), (weights, "weight"), (bounds, "bounds")):
            if d[k] is not None:
                store[d["number"]] = d[k]
        return Node(d["kind"], d["columns"], [read(c) for c in d["children"]], d["by"], d["centres"], d["fill"], d["masks"], d["number"], d.get("given", []), d.get("ranges", []))

    root = read(whole["root"])
    return Model(whole["columns"], root, whole["rows"], bins, weights, bounds)


def _joined(models: list[Model], columns: list[str], kind: str, weights: list[float] | None) -> Model:
    """One root over the trees of several models, numbered anew."""
    root = Node(kind, list(range(len(columns))), [], "data" if kind == "product" else "")
    bins, own, bounds = {}, {}, {}
    n = 1
    for k, m in enumerate(models):
        place = [columns.index(c) for c in m.columns]
        tree = copy.deepcopy(m.root)
        for node in list(tree.walk()):
            old, node.number = node.number, n
            n += 1
            node.columns, node.given = [place[c] for c in node.columns], [place[c] for c in node.given]
            for new, its in ((bins, m.bins), (own, m.weights), (bounds, m.bounds)):
                if old in its:
                    new[node.number] = copy.deepcopy(its[old])
        root.children.append(tree)
        if weights is not None:
            own[tree.number] = weights[k]
            box: dict[str, list[float]] = {}
            for leaf in tree.walk():
                if leaf.kind == "leaf" and leaf.number in bins:
                    b, c = bins[leaf.number], columns[leaf.columns[0]]
                    lo, hi = min(b["lo"]), max(b["hi"])
                    box[c] = [min(lo, box[c][0]), max(hi, box[c][1])] if c in box else [lo, hi]
            bounds[tree.number] = box
    root.number = 0
    grid = {c: g for m in models for c, g in m.grid.items()}
    return Model(columns, root, models[0].rows, bins, own, bounds, grid)


def times(*models: Model) -> Model:
    """The product of models of different columns."""
    columns = [c for m in models for c in m.columns]
    if len(set(columns)) < len(columns):
        raise ValueError("the models share columns")
    return _joined(list(models), columns, "product", None)


def mixed(parts: list[tuple[float, Model]]) -> Model:
    """The weighted sum of models of the same columns; weights are taken as shares. It answers queries; rows are not routed to its parts, as those have no centres."""
    columns = parts[0][1].columns
    if any(sorted(m.columns) != sorted(columns) for _, m in parts):
        raise ValueError("the models have different columns")
    return _joined([m for _, m in parts], list(columns), "sum", [w for w, _ in parts])


def formula(model: Model) -> str:
    """The density as an expression: sums of weighted terms, products, and f<number>(column) for leaves."""

    def write(node: Node) -> str:
        if node.kind == "leaf":
            return f"f{node.number}({model.columns[node.columns[0]]})"
        kids = [write(c) for c in node.children]
        if node.kind == "product":
            return " * ".join(kids)
        if node.kind == "factorize":
            return f"{kids[0]} * box(" + ", ".join(kids[1:]) + ")"
        if node.kind == "split":
            return "route(" + ", ".join(kids) + ")"
        return "(" + " + ".join(f"{w:.6g} * {k}" for w, k in zip(_shares(model, node), kids, strict=True)) + ")"

    return write(model.root)
