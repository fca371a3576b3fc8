"""Declarative pipelines: named layers, strict parameters, acceptance, and the combined runner.

A step reads a layer (a DataFrame), applies a registered tool and may save a new
layer.  Plans stay lazy; an action happens only where a step has an acceptance
rule, which needs the metric's value.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images as im
from ..operators import neighbourhood as nb
from ..sources import grids

#: Names a tool also answers to, fixed values.
ALIASES = {"edge": "edgedetection", "rotateandscale": "rotatescale", "affine": "affinetransform", "affinematrix": "affinetransform"}


@dataclass(frozen=True)
class Acceptance:
    expected_success: bool = True
    message_contains: str = ""
    metric: str = ""
    minimum: float | None = None
    maximum: float | None = None
    max_elapsed_ms: float = 0.0


@dataclass(frozen=True)
class Step:
    tool: str
    parameters: dict[str, str] = field(default_factory=dict)
    input_layer: str = "source"
    output_layer: str = ""
    enabled: bool = True
    acceptance: Acceptance | None = None


@dataclass
class ToolResult:
    """What a tool returns: rows or an image, metrics, success and a message."""

    output: DataFrame | None = None
    success: bool = True
    message: str = ""
    metrics: Callable[[], dict[str, float]] = dict
    elapsed_ms: float = 0.0


@dataclass
class StepResult:
    step: Step
    status: str
    message: str = ""


class Layers:
    """Layers by name, in either case."""

    def __init__(self, **named: DataFrame):
        self.named = {k.lower(): v for k, v in named.items()}

    def get(self, name: str) -> DataFrame | None:
        return self.named.get(name.strip().lower())

    def set(self, name: str, layer: DataFrame) -> None:
        if not name.strip():
            raise ValueError("a layer needs a name")
        self.named[name.strip().lower()] = layer


# -- parameters -----------------------------------------------------------------------------
def normal_name(tool: str) -> str:
    """Trimmed, lower-case, without spaces and underscores and a final "tool"."""
    name = tool.strip().replace(" ", "").replace("_", "").lower()
    name = name[: -len("tool")] if name.endswith("tool") and name != "tool" else name
    return ALIASES.get(name, name)


def parse(value: str, kind):
    """One strictly parsed parameter; malformed or non-finite values are errors."""
    text = value.strip()
    if kind is bool:
        if text.lower() not in ("true", "false"):
            raise ValueError(f"not a boolean: {value!r}")
        return text.lower() == "true"
    if kind in (int, float):
        out = kind(text)
        if not math.isfinite(out):
            raise ValueError(f"not finite: {value!r}")
        return out
    if isinstance(kind, tuple):
        hit = [k for k in kind if k.lower() == text.lower()]
        if not hit:
            raise ValueError(f"{value!r} is none of {kind}")
        return hit[0]
    return text


def bind(parameters: dict[str, str] | list[tuple[str, str]], known: dict) -> dict:
    """Values for ``known`` (name -> (type, default)); unknown and repeated keys are errors, whatever their case."""
    pairs = list(parameters.items()) if isinstance(parameters, dict) else list(parameters)
    names, out = {k.lower(): k for k in known}, {}
    for key, value in pairs:
        name = names.get(key.strip().lower())
        if name is None:
            raise ValueError(f"unknown parameter {key!r}")
        if name in out:
            raise ValueError(f"parameter {key!r} is given twice")
        out[name] = parse(value, known[name][0])
    return {k: out.get(k, v[1]) for k, v in known.items()}


def odd(name: str, value: int, least: int = 1) -> None:
    if value < least or value % 2 == 0:
        raise ValueError(f"{name} must be odd and at least {least}")


# -- tools ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Tool:
    known: dict
    run: Callable[[DataFrame, dict], DataFrame]
    check: Callable[[dict], None] = lambda p: None


def _check_threshold(p: dict) -> None:
    if not 0 <= p["low"] <= 255 or not 0 <= p["high"] <= 255 or p["low"] > p["high"]:
        raise ValueError("limits must lie in 0..255, in order")
    odd("size", p["size"], 3)


def _threshold(px: DataFrame, p: dict) -> DataFrame:
    if p["mode"] == "Adaptive":
        return nb.adaptive_threshold(px, p["size"], p["offset"])
    return nb.threshold(px, p["low"], p["high"] if p["mode"] == "Range" else None, p["invert"])


def _filter(px: DataFrame, p: dict) -> DataFrame:
    if p["kind"] == "Median":
        half = p["size"] // 2

        def kernel(v: np.ndarray, real: np.ndarray) -> tuple[np.ndarray]:
            return (np.nan_to_num(nb._window_median(v, p["size"], True)[0]).astype(np.int32),)

        return nb.tiled(px, "image_id", "y", "x", "v", half, kernel, "v int")
    return nb.box_mean(px, p["size"]).select("image_id", "y", "x", F.bround("mean", 0).cast("int").alias("v"))


def _edges(px: DataFrame, p: dict) -> DataFrame:
    if p["kind"] == "Laplacian":
        out = nb.convolve(px, nb.LAPLACIAN)
        return out.withColumn("v", F.least(F.lit(255.0), F.abs("v")).cast("int"))
    kernels = (nb.SOBEL_X, nb.SOBEL_Y) if p["kind"] == "Sobel" else (nb.SCHARR_X, nb.SCHARR_Y)
    return nb.gradient(px, *kernels).select("image_id", "y", "x", F.least(F.lit(255.0), "magnitude").cast("int").alias("v"))


def _warped(px: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A whole-image kernel over pixel rows."""
    return im.on_images(grids.images(px), im.as_pixels(f), [("y", "int"), ("x", "int"), ("v", "int")])


def _check_rotate(p: dict) -> None:
    if p["scale"] <= 0:
        raise ValueError("scale must be positive")


def _corners(p: dict, side: str) -> np.ndarray:
    return np.array([[p[f"{side}{axis}{i}"] for axis in "xy"] for i in range(3)], float)


def _check_affine(p: dict) -> None:
    im.affine_from_points(_corners(p, "s"), _corners(p, "d"))
    if not (0 < p["width"] <= im.MAX_SIDE and 0 < p["height"] <= im.MAX_SIDE) or not 0 <= p["min_valid"] <= 1:
        raise ValueError("output size or ratio out of range")


def _affine(px: DataFrame, p: dict) -> DataFrame:
    m = im.affine_from_points(_corners(p, "s"), _corners(p, "d"))
    return _warped(px, lambda a: im.warp(a, m, p["width"], p["height"], p["min_valid"]))


_PLACES = {f"{s}{axis}{i}": (float, float(v[axis == "y"])) for s in "sd" for i, v in enumerate(((0, 0), (1, 0), (0, 1))) for axis in "xy"}

TOOLS: dict[str, Tool] = {
    "threshold": Tool({"mode": (("Fixed", "Range", "Adaptive"), "Fixed"), "low": (int, 128), "high": (int, 255), "invert": (bool, False), "size": (int, 3), "offset": (float, 0.0)}, _threshold, _check_threshold),
    "filter": Tool({"kind": (("Box", "Median"), "Box"), "size": (int, 3)}, _filter, lambda p: odd("size", p["size"])),
    "edgedetection": Tool({"kind": (("Sobel", "Scharr", "Laplacian"), "Sobel")}, _edges),
    "morphology": Tool({"op": (("erode", "dilate", "open", "close"), "open"), "size": (int, 3)}, lambda px, p: nb.morphology(px, p["op"], p["size"]), lambda p: odd("size", p["size"])),
    "rotatescale": Tool({"scale": (float, 100.0), "angle": (float, 0.0)}, lambda px, p: _warped(px, lambda a: im.rotate_scale(a, p["scale"], p["angle"])), _check_rotate),
    "affinetransform": Tool({**_PLACES, "width": (int, 64), "height": (int, 64), "min_valid": (float, 0.0)}, _affine, _check_affine),
    "preprocess": Tool({"low": (int, 128), "invert": (bool, False)}, lambda px, p: nb.preprocess(px, p["low"], p["invert"])),
}


def register(name: str, tool: Tool) -> None:
    """Adds a tool of the user's own."""
    TOOLS[normal_name(name)] = tool


def create(step: Step) -> Callable[[DataFrame], DataFrame]:
    """The step's tool with its parameters bound and checked, before any plan is built."""
    tool = TOOLS.get(normal_name(step.tool))
    if tool is None:
        raise ValueError(f"unknown tool {step.tool!r}")
    p = bind(step.parameters, tool.known)
    tool.check(p)
    return lambda layer: tool.run(layer, p)


def image_metrics(px: DataFrame) -> dict[str, float]:
    """Count, mean, extremes and non-zero pixels of a layer: one action."""
    row = px.agg(F.count("v").alias("Count"), F.avg("v").alias("Mean"), F.min("v").alias("Min"), F.max("v").alias("Max"), F.count_if(F.col("v") != 0).alias("NonZero")).first()
    return {k: float(v) for k, v in row.asDict().items() if v is not None}


def evaluate(rule: Acceptance, result: ToolResult) -> list[str]:
    """All reasons why a result is not accepted."""
    out = []
    if result.success != rule.expected_success:
        out.append(f"success is {result.success}, expected {rule.expected_success}")
    if rule.max_elapsed_ms > 0 and result.elapsed_ms > rule.max_elapsed_ms:
        out.append(f"took {result.elapsed_ms:.1f} ms, at most {rule.max_elapsed_ms:.1f}")
    if rule.message_contains.strip() and rule.message_contains.lower() not in result.message.lower():
        out.append(f"message lacks {rule.message_contains!r}")
    if rule.metric.strip() and (rule.minimum is not None or rule.maximum is not None):
        value = {k.lower(): v for k, v in result.metrics().items()}.get(rule.metric.strip().lower())
        if value is None:
            out.append(f"no metric {rule.metric!r}")
        else:
            if rule.minimum is not None and value < rule.minimum:
                out.append(f"{rule.metric} {value:g} < {rule.minimum:g}")
            if rule.maximum is not None and value > rule.maximum:
                out.append(f"{rule.metric} {value:g} > {rule.maximum:g}")
    return out


def run(steps: list[Step], layers: Layers) -> list[StepResult]:
    """Enabled steps in order; the first that fails ends the run.

    A step that is expected to fail must be the last enabled one.  A step's
    output is saved under its layer's name only if the step is accepted.
    """
    enabled = [s for s in steps if s.enabled]
    if not enabled:
        raise ValueError("a pipeline needs an enabled step")
    if any(s.acceptance and not s.acceptance.expected_success for s in enabled[:-1]):
        raise ValueError("a step expected to fail must be the last")
    out = []
    stopped = False
    for s in steps:
        if stopped or not s.enabled:
            out.append(StepResult(s, "Skipped", "disabled" if not s.enabled else "an earlier step failed"))
            continue
        try:
            layer = layers.get(s.input_layer)
            if layer is None:
                raise ValueError(f"no layer {s.input_layer!r}")
            made = create(s)(layer)
            result = ToolResult(made, True, "", lambda made=made: image_metrics(made))
        except ValueError as e:
            result = ToolResult(None, False, str(e))
        reasons = evaluate(s.acceptance, result) if s.acceptance else ([] if result.success else [result.message])
        if reasons:
            out.append(StepResult(s, "Failed", "; ".join(reasons)))
            stopped = True
            continue
        out.append(StepResult(s, "Passed", result.message))
        if result.output is not None and s.output_layer.strip():
            layers.set(s.output_layer, result.output)
    return out


def load(text: str) -> list[Step]:
    """Steps from JSON; keys that a step or its acceptance does not have are errors."""
    steps = []
    for item in json.loads(text):
        item = dict(item)
        rule = item.pop("acceptance", None)
        for given, kind in ((item, Step), (rule or {}, Acceptance)):
            odd_keys = set(given) - {f.name for f in fields(kind)}
            if odd_keys:
                raise ValueError(f"unknown keys {sorted(odd_keys)}")
        steps.append(Step(**item, acceptance=Acceptance(**rule) if rule else None))
    return steps


def dump(steps: list[Step]) -> str:
    return json.dumps([{**s.__dict__, "acceptance": s.acceptance.__dict__ if s.acceptance else None} for s in steps])


def combined(tools_2d: list[tuple[str, Callable | None]], tools_3d: list[tuple[str, Callable | None]]) -> tuple[bool, list[dict]]:
    """All 2-D, then all 3-D tools, never stopping: one row a tool; nothing configured is a failure.

    A tool is a function that returns whether it has passed (and may act on a
    plan); an exception becomes a row.
    """
    rows = []
    for kind, tools in (("2D", tools_2d), ("3D", tools_3d)):
        for name, tool in tools:
            row = {"kind": kind, "tool": name, "passed": False, "status": "ConfigurationError", "message": "Unconfigured"}
            if tool is not None:
                try:
                    ok = bool(tool())
                    row |= {"passed": ok, "status": "Passed" if ok else "Failed", "message": ""}
                except Exception as e:  # any tool failure is a result here
                    row |= {"status": "Exception", "message": str(e).splitlines()[0] if str(e) else type(e).__name__}
            rows.append(row)
    return bool(rows) and all(r["passed"] for r in rows), rows
