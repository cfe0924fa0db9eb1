"""Feature roles: which column plays which part. Configuration read on the driver, never data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

ROLE_FILE = str(Path(__file__).with_name("feature_roles.json"))  #: the roles of the library's own tables


@dataclass(frozen=True)
class Roles:
    key: str
    id: str
    target: str
    time_vars: tuple[str, str]
    target_mask: str
    timevarying: tuple[str, ...]
    intervention: tuple[str, ...] = ()
    static: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    features_divider: dict[str, float] = field(default_factory=dict)
    inputs: tuple[str, ...] | None = None

    @property
    def model_inputs(self) -> list[str]:
        """Inputs of the tabular models: all of these roles, unless `inputs` names some."""
        if self.inputs is not None:
            return list(self.inputs)
        return [*self.timevarying, *self.static, *self.counts, *self.time_vars]

    @property
    def scaled(self) -> list[str]:
        """Columns brought to mean 0 and deviation 1: all inputs not transformed otherwise."""
        other = {*self.features_divider, self.target, self.timevarying[0]}
        return [c for c in dict.fromkeys([*self.timevarying, *self.static, *self.intervention]) if c not in other]

    def among(self, columns) -> "Roles":
        """The same roles over a table that has only `columns`."""
        have = set(columns)
        lists = {name: tuple(c for c in getattr(self, name) if c in have) for name in ("timevarying", "intervention", "static", "counts")}
        return replace(self, **lists, features_divider={c: v for c, v in self.features_divider.items() if c in have})

    def without_interventions(self) -> "Roles":
        return replace(self, timevarying=tuple(c for c in self.timevarying if c not in self.intervention))


def roles_from(entry: dict) -> Roles:
    lists = ("time_vars", "timevarying", "intervention", "static", "counts")
    return Roles(**{k: tuple(v) if k in lists else v for k, v in entry.items()})


def load_roles(path: str = ROLE_FILE, dataset: str = "clinical", feature_set: str = "features") -> Roles:
    """Look up by the dataset name's first `_`-separated word, then by feature set."""
    with open(path) as f:
        return roles_from(json.load(f)[dataset.split("_")[0]][feature_set])
