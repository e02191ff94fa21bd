"""Run directories: claims, artifact manifests, fingerprints, and the comparison of two runs."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from ..functions.digests import file_sha256, json_sha256
from ..sources.runs import CLAIM, FINGERPRINT

# The layers of a comparison, its outcomes, and files that record operation rather than results.
TRUE, FALSE, NOT_APPLICABLE, NOT_CHECKED = "true", "false", "not_applicable", "not_checked"
MATRIX_FIELDS = {"matrix_contract_match": "matrix_contract_sha256", "matrix_row_identity_match": "row_identity_sha256", "matrix_value_match": "matrix_sha256"}
OPERATIONAL = (CLAIM, FINGERPRINT, "performance.jsonl", "invocations.jsonl")


class RunError(ValueError):
    """A run directory that is taken, unfinished or changed."""


def claim(run_dir: str, identity: Mapping) -> str:
    """Take a new run directory; exactly one process succeeds."""
    folder = Path(run_dir)
    folder.mkdir(parents=True, exist_ok=True)
    digest = json_sha256(identity)
    try:
        with open(folder / CLAIM, "x") as f:
            json.dump({"identity_sha256": digest, "claimed_at": time.time(), "pid": os.getpid()}, f, sort_keys=True)
    except FileExistsError:
        raise RunError(f"{run_dir} is taken") from None
    return digest


def artifacts(run_dir: str) -> dict[str, dict]:
    base = Path(run_dir)
    files = sorted(p for p in base.rglob("*") if p.is_file() and p.relative_to(base).as_posix() not in OPERATIONAL)
    role = lambda p: "split_artifact" if p.relative_to(base).parts[0] == "split" else "prediction" if "predictions" in p.name else "result"
    return {p.relative_to(base).as_posix(): {"sha256": file_sha256(p), "bytes": p.stat().st_size, "role": role(p)} for p in files}


def fingerprint(run_dir: str, identity: Mapping) -> dict:
    """Seal a finished run."""
    payload = {"identity": dict(identity), "artifacts": artifacts(run_dir)}
    sealed = {"payload": payload, "payload_sha256": json_sha256(payload)}
    try:
        with open(Path(run_dir) / FINGERPRINT, "x") as f:
            json.dump(sealed, f, sort_keys=True, indent=2)
    except FileExistsError:
        raise RunError(f"{run_dir} is sealed") from None
    return sealed


def read_fingerprint(run_dir: str, verify: bool = True) -> dict:
    path = Path(run_dir) / FINGERPRINT
    if not path.is_file():
        raise RunError(f"{run_dir} is unfinished")
    sealed = json.loads(path.read_text())
    if json_sha256(sealed["payload"]) != sealed["payload_sha256"]:
        raise RunError(f"the fingerprint of {run_dir} was changed")
    if verify and artifacts(run_dir) != sealed["payload"]["artifacts"]:
        raise RunError(f"artifacts of {run_dir} were changed")
    return sealed


def run_identity(task: str, inputs: Mapping[str, str | None], split: Mapping, models: list, matrices: Mapping, encoder: Mapping | None = None) -> dict:
    """The scientific identity of a run: what went in and how it was treated, nothing about where and when."""
    return {"task": {"task_id": task}, "run_contract": {"inputs": dict(inputs), "split": dict(split)}, "models": models, "matrices": dict(matrices), "encoder": dict(encoder) if encoder else None}


@dataclass(frozen=True)
class Comparison:
    statuses: dict[str, str]
    differences: tuple[str, ...]

    @property
    def matches(self) -> bool:
        return not self.differences


def compare(first: Mapping, second: Mapping) -> Comparison:
    """Layer by layer: the same, different, or nothing to compare. Runs of different tasks cannot be compared."""
    if (first.get("task") or {}).get("task_id") != (second.get("task") or {}).get("task_id"):
        raise RunError("runs of different tasks")
    same = lambda k: TRUE if first.get(k) == second.get(k) else FALSE
    status = {
        "run_contract_match": TRUE if same("run_contract") == TRUE and same("task") == TRUE else FALSE,
        "model_configuration_match": same("models"), "model_output_match": NOT_CHECKED,
    }
    for name, field in (("encoder_contract_match", "embedding_contract_sha256"), ("embedding_table_match", "embedding_table_sha256")):
        a, b = ((x.get("encoder") or {}).get(field) for x in (first, second))
        status[name] = NOT_APPLICABLE if a is None and b is None else TRUE if a == b else FALSE
    differences = [k for k, v in status.items() if v == FALSE]
    left, right = first.get("matrices") or {}, second.get("matrices") or {}
    for name, field in MATRIX_FIELDS.items():
        values = {k: (left.get(k, {}).get(field), right.get(k, {}).get(field)) for k in sorted({*left, *right})}
        values = {k: v for k, v in values.items() if v != (None, None) or (k in left) != (k in right)}
        off = [k for k, (a, b) in values.items() if a is None or b is None or a != b]
        status[name] = NOT_APPLICABLE if not values else FALSE if off else TRUE
        differences += [f"{name}:{k}" for k in off]
    layers = [status[n] for n in MATRIX_FIELDS]
    status["matrix_match"] = NOT_APPLICABLE if set(layers) == {NOT_APPLICABLE} else FALSE if FALSE in layers else TRUE
    return Comparison(status, tuple(differences))


def compare_directories(first: str, second: str) -> Comparison:
    a, b = (read_fingerprint(d)["payload"]["identity"] for d in (first, second))
    return compare(a, b)
