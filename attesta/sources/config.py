"""Configuration from CSV files. What is missing or empty raises an error; nothing falls back silently."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from pathlib import Path

METADATA = Path(__file__).resolve().parents[1] / "metadata"
SIGNALS = ("NIK_MATCH", "DOB_MATCH", "PHONE_MATCH", "EMAIL_MATCH", "DOB_CONFLICT", "PHONE_CONFLICT", "EMAIL_CONFLICT")


class ConfigError(RuntimeError):
    """Configuration that the engine can't work with."""


def read_rows(path: str | Path) -> list[dict[str, str | None]]:
    """Rows of a CSV file as text; empty fields are None."""
    with open(path, newline="", encoding="utf-8") as f:
        return [{k: v if v != "" else None for k, v in row.items()} for row in csv.DictReader(f)]


def active(rows: list[dict]) -> list[dict]:
    return [r for r in rows if (r.get("status") or "").upper() == "ACTIVE"]


def thresholds(scope: str, path: str | Path = METADATA / "thresholds.csv") -> dict[str, float]:
    """Active thresholds of a scope."""
    found = {r["key"]: float(r["value"]) for r in active(read_rows(path)) if r["scope"] == scope}
    if not found:
        raise ConfigError(f"no active thresholds for {scope} in {path}")
    return found


def signals(path: str | Path = METADATA / "signals.csv") -> dict[str, int]:
    """Scores of the seven signals, conflicts negative; all of them are needed."""
    found = {r["signal"]: int(r["score"]) for r in active(read_rows(path))}
    if missing := [s for s in SIGNALS if s not in found]:
        raise ConfigError(f"no active score for {', '.join(missing)} in {path}")
    return found


def priorities(path: str | Path = METADATA / "survivorship.csv") -> list[tuple[str, str, int]]:
    """(attribute, source system, priority) of the active rows."""
    found = [(r["attribute_name"], r["source_system"], int(r["priority"])) for r in active(read_rows(path))]
    if not found:
        raise ConfigError(f"no active priorities in {path}")
    return found


@dataclass(frozen=True)
class Rule:
    rule_id: str
    dataset: str
    column_name: str | None
    dimension: str | None
    rule_name: str | None
    severity: str
    metric_type: str
    threshold: float
    status: str | None
    test_sql: str


def rules(path: str | Path = METADATA / "rules.csv") -> list[Rule]:
    """All rules by id, drafts included (a rule's status does not switch it off)."""
    out = []
    for r in read_rows(path):
        if not (r["test_sql"] or "").strip():
            raise ConfigError(f"rule {r['rule_id']} has no test_sql")
        out.append(Rule(r["rule_id"], r["dataset"], r["column_name"], r["dimension"], r["rule_name"], r["severity"], r["metric_type"], float(r["threshold"]), r["status"], r["test_sql"]))
    return sorted(out, key=lambda r: r.rule_id)


@dataclass(frozen=True)
class Contract:
    contract_id: str
    source_system: str
    file_name: str
    column_name: str
    data_type: str
    is_nullable: bool
    is_required: bool
    severity: str
    status: str

    @property
    def enforced(self) -> bool:
        return self.status == "APPROVED"


def contracts(path: str | Path = METADATA / "contracts.csv") -> list[Contract]:
    """All column contracts by file and id; a missing file is an error."""
    rows = read_rows(path)
    yes = lambda v: (v or "").upper() == "TRUE"
    out = [Contract(r["contract_id"], r["source_system"], r["file_name"], r["column_name"], (r["data_type"] or "").upper(), yes(r["is_nullable"]), yes(r["is_required"]), r["severity"], r["status"]) for r in rows]
    return sorted(out, key=lambda c: (c.file_name, c.contract_id))
