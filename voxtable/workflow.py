"""Named steps and linear pipelines of them over a context of DataFrames."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

from voxtable.operators import classify, cluster, filters, gates, measure, reduce, segment

STEP_REGISTRY: dict[str, dict[str, Callable]] = {
    "imageprocessing": {"gaussian_blur": filters.gaussian_blur, "median_filter": filters.median_filter, "enhance_contrast": filters.enhance_contrast, "subtract_background": filters.subtract_background},
    "segmentation": {"threshold_mask": segment.threshold_mask, "label_components": segment.label_components, "watershed_split": segment.watershed_split, "filter_by_size": segment.filter_by_size,
                     "labels_from_points": segment.labels_from_points, "cellpose_segmentation": segment.apply_model},
    "measurements": {"extract_measurements": measure.extract_measurements},
    "clustering": {"kmeans": cluster.kmeans, "gaussian_mixture": cluster.gaussian_mixture, "hierarchical": cluster.hierarchical, "auto_k_kmeans": cluster.auto_k_kmeans},
    "reduction": {"pca": reduce.pca, "isomap": reduce.isomap, "laplacian_eigenmap": reduce.laplacian_eigenmap, "tsne": reduce.tsne},
    "gates": {"polygon_gate": gates.polygon_gate, "rectangle_gate": gates.rectangle_gate},
    "classification": {"class_map": classify.class_map, "train_classifier": classify.train_classifier, "predict": classify.predict},
}

#: Arguments that carry data; the others configure a step.
DATA_ARGUMENTS = frozenset(("volume", "volumes", "mask", "intensity", "labels", "points", "shape", "label_shape", "intensity_shape", "data", "x", "y", "vertices", "classes", "model", "crops", "extra"))


def register_step(category: str, name: str | None = None) -> Callable:
    """Decorator that adds a function to the registry."""

    def add(f: Callable) -> Callable:
        STEP_REGISTRY.setdefault(category, {})[name or f.__name__] = f
        return f

    return add


def get_step_function(category: str, name: str) -> Callable:
    found = STEP_REGISTRY.get(category, {}).get(name)
    if found is None:
        near = sorted(c for c, steps in STEP_REGISTRY.items() if name in steps)
        raise KeyError(f"{category} has no step {name}" + (f"; {', '.join(near)} has one" if near else ""))
    return found


def available_steps(category: str | None = None) -> dict[str, list[str]] | list[str]:
    """Step names of every category, or of one."""
    if category is None:
        return {c: sorted(s) for c, s in STEP_REGISTRY.items()}
    if category not in STEP_REGISTRY:
        raise KeyError(f"unknown category '{category}'")
    return sorted(STEP_REGISTRY[category])


@dataclass(eq=False)
class Step:
    """A registered function, its parameters, and the context keys of its data and result.

    Steps compare by identity, so that equal steps of a pipeline stay apart.
    """

    category: str
    function_name: str
    params: dict[str, Any] = field(default_factory=dict)
    input_keys: dict[str, str] = field(default_factory=dict)
    output_key: str = "result"
    comment: str = ""

    @property
    def function(self) -> Callable:
        return get_step_function(self.category, self.function_name)

    def run(self, context: dict[str, Any]) -> Any:
        """The function's result; a parameter wins over an input of the same name."""
        call = dict(self.params)
        for argument, key in self.input_keys.items():
            if argument in call:
                continue
            if key not in context:
                raise KeyError(f"{self.function_name} reads {key} for {argument}, which is missing from the results so far ({', '.join(sorted(context)) or 'none'})")
            call[argument] = context[key]
        return self.function(**call)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Step:
        return cls(**json.loads(text))


class Pipeline:
    """Steps in order; each result is stored under its output key for the steps after it."""

    def __init__(self, steps: list[Step] | None = None):
        self.steps = list(steps or [])

    def add_step(self, step: Step) -> Pipeline:
        self.steps.append(step)
        return self

    def insert_step(self, at: int, step: Step) -> None:
        self.steps.insert(at, step)

    def remove_step(self, at: int) -> Step:
        return self.steps.pop(at)

    def delete_step(self, step: Step) -> None:
        self.steps = [s for s in self.steps if s is not step]

    def move_step(self, start: int, end: int) -> None:
        self.steps.insert(end, self.steps.pop(start))

    def __len__(self) -> int:
        return len(self.steps)

    def __iter__(self) -> Iterator[Step]:
        return iter(self.steps)

    def run(self, context: dict[str, Any] | None = None) -> dict[str, Any]:
        """The context after all steps. DataFrames stay lazy; two results of a step go to KEY and KEY_scores."""
        out = dict(context or {})
        for step in self.steps:
            result = step.run(out)
            if isinstance(result, tuple):
                result, out[f"{step.output_key}_scores"] = result
            out[step.output_key] = result
        return out


@dataclass(frozen=True)
class ParamSpec:
    name: str
    kind: str
    default: Any
    required: bool
    optional: bool


def _kind(p: inspect.Parameter) -> str:
    if p.default not in (None, inspect.Parameter.empty) and type(p.default) in (bool, int, float, str):
        return type(p.default).__name__
    text = str(p.annotation)
    return next((k for k in ("bool", "int", "float") if k in text), "str")


def editable_parameters(category: str, name: str) -> list[ParamSpec]:
    """The configuration arguments of a step, without those that carry data."""
    out = []
    for p in inspect.signature(get_step_function(category, name)).parameters.values():
        if p.name not in DATA_ARGUMENTS and p.kind is not inspect.Parameter.VAR_KEYWORD:
            required = p.default is inspect.Parameter.empty
            out.append(ParamSpec(p.name, _kind(p), None if required else p.default, required, p.default is None or "None" in str(p.annotation)))
    return out


def coerce_params(category: str, name: str, texts: dict[str, str]) -> dict[str, Any]:
    """Values from their texts; an empty text of an optional parameter is None."""
    out: dict[str, Any] = {}
    for spec in editable_parameters(category, name):
        if spec.name not in texts:
            continue
        text = str(texts[spec.name]).strip()
        if not text and spec.optional:
            out[spec.name] = None
        elif spec.kind == "bool":
            out[spec.name] = text.lower() in ("1", "true", "yes", "on")
        else:
            out[spec.name] = {"int": int, "float": float, "str": str}[spec.kind](text)
    return out


def summarize_params(step: Step) -> str:
    """A step's parameters in one line; also its job description."""
    return ", ".join(f"{k}={v}" for k, v in step.params.items()) or "(default parameters)"
