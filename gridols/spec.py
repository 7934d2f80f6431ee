"""What a fit is asked to do: design width, contrasts, missingness rules; read from YAML or built in code."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Contrast:
    """One row tests T, several test F."""

    name: str
    rows: tuple[tuple[float, ...], ...]
    kind: str

    @staticmethod
    def of(name: str, vector) -> Contrast:
        value = parse_vector(vector) if isinstance(vector, str) else vector
        nested = bool(value) and isinstance(value[0], list | tuple)
        rows = tuple(tuple(float(x) for x in r) for r in (value if nested else [value]))
        return Contrast(name, rows, "F" if nested else "T")

    @property
    def matrix(self) -> np.ndarray:
        return np.array(self.rows)

    def check(self, p: int) -> None:
        if {len(r) for r in self.rows} != {p}:
            raise ValueError(f"contrast {self.name} does not have {p} columns")
        if np.linalg.matrix_rank(self.matrix) < len(self.rows):
            raise ValueError(f"contrast {self.name} does not have full row rank")


def parse_vector(text: str):
    """A list, or list of lists, from text that may lack commas between numbers or brackets."""
    s = re.sub(r"\]\s*\[", "],[", text.strip())
    s = re.sub(r"(?<=[0-9.])\s+(?=[-+0-9.])", ",", s)
    return ast.literal_eval(s)


def fraction(value) -> float:
    """A share in [0, 1], given as a number or as "10%"."""
    share = float(value[:-1]) / 100 if isinstance(value, str) and value.strip().endswith("%") else float(value)
    if not 0 <= share <= 1:
        raise ValueError("MinPercent must be between 0 and 1")
    return share


@dataclass(frozen=True)
class Model:
    p: int
    contrasts: tuple[Contrast, ...] = ()
    min_percent: float | None = None
    min_n: int | None = None
    threshold: float | None = None
    output_cov: bool = True
    min_log: float = -323.3062153431158

    def __post_init__(self):
        for c in self.contrasts:
            c.check(self.p)

    @property
    def t(self) -> list[Contrast]:
        return [c for c in self.contrasts if c.kind == "T"]

    @property
    def f(self) -> list[Contrast]:
        return [c for c in self.contrasts if c.kind == "F"]


def from_config(config: dict, p: int) -> Model:
    """A model from a configuration mapping; the width p is that of the design, whatever the first contrast is."""
    listed = []
    for k, entry in enumerate(config.get("contrasts") or []):
        body = next(iter(entry.values())) if len(entry) == 1 and isinstance(next(iter(entry.values())), dict) else entry
        listed.append(Contrast.of(str(body.get("name", f"c{k + 1}")), body["vector"]))
    rules = config.get("Missingness") or {}
    percent = rules.get("MinPercent", rules.get("minpercent"))
    least = rules.get("MinN", rules.get("minn"))
    return Model(
        p, tuple(listed), None if percent is None else fraction(percent), None if least is None else int(least),
        None if config.get("data_mask_thresh") is None else float(config["data_mask_thresh"]), bool(config.get("OutputCovB", True)), float(config.get("minlog", -323.3062153431158)),
    )


def read_yaml(path: str) -> dict:
    import yaml

    from gridols.sources.folders import read_text

    return yaml.safe_load(read_text(path)) or {}
