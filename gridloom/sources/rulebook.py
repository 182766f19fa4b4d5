"""Rule files (TOML) as long-form rule tables, and manifests as entry tables."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_rules(text: str, fields: dict[str, str]) -> list[dict]:
    """Rows tier-less: kind, key, target and a dict of known settings; unknown keys are passed over."""
    book = tomllib.loads(text)
    known = lambda x: {f: x.get(f) for f in fields}
    rows = [{"kind": "default", "key": None, "target": None, "settings": known(book.get("default", {}))}]
    for kind, section in (("profile", "profiles"), ("override", "layers")):
        rows += [{"kind": kind, "key": k, "target": None, "settings": known(v)} for k, v in sorted(book.get(section, {}).items())]
    rows += [{"kind": "assign", "key": k, "target": v, "settings": known({})} for k, v in sorted(book.get("assign", {}).items())]
    return rows


def rule_table(spark: SparkSession, tiers: Sequence[str | None], fields: dict[str, str]) -> DataFrame:
    """One table of the tiers' texts, the project's first; a missing or broken text is an empty tier."""
    rows = []
    for tier, text in enumerate(tiers):
        try:
            found = parse_rules(text or "", fields)
        except tomllib.TOMLDecodeError as error:
            print(f"rules of tier {tier} are passed over: {error}")
            found = []
        rows += [(tier, r["kind"], r["key"], r["target"], tuple(r["settings"][f] for f in fields)) for r in found]
    return spark.createDataFrame(rows, f"tier int, kind string, key string, target string, settings struct<{', '.join(f'{f}: {k}' for f, k in fields.items())}>")


RULES_FILE = "rules.toml"


def find_rules(source: str, name: str = RULES_FILE) -> str | None:
    """The text of the first rule file that can be parsed: beside the source, else in the working folder; a broken one is reported and passed over."""
    for folder in (Path(source).parent, Path.cwd()):
        try:
            tomllib.loads(text := (folder / name).read_text())
            return text
        except FileNotFoundError:
            continue
        except (OSError, tomllib.TOMLDecodeError) as error:
            print(f"{folder / name} is passed over: {error}")
    return None


def global_rules(name: str = RULES_FILE, program: str = "gridloom") -> str | None:
    """The text of the user's own rule file, None on any failure."""
    try:
        return (_config(program) / name).read_text()
    except OSError:
        return None


def _config(program: str) -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / program


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(_literal, value))}]"
    return json.dumps(value) if isinstance(value, str) else repr(value)


def rules_text(rows: list) -> str:
    """Rows (kind, key, target, settings) of one tier as the text that parse_rules reads."""
    out = []
    for kind, section in (("default", "default"), ("profile", "profiles"), ("override", "layers")):
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["key"] or ""):
            found = r["settings"] if isinstance(r["settings"], dict) else r["settings"].asDict()
            out.append(f"[{section}]" if kind == "default" else f"[{section}.{json.dumps(r['key'])}]")
            out += [f"{f} = {_literal(v)}" for f, v in found.items() if v is not None]
    out.append("[assign]")
    out += [f"{json.dumps(r['key'])} = {json.dumps(r['target'])}" for r in sorted((r for r in rows if r["kind"] == "assign"), key=lambda r: r["key"])]
    return "\n".join(out) + "\n"


def write_rules(rules: DataFrame, paths: Sequence[str | None]) -> tuple[int, list[str]]:
    """Write each tier's rules to its path (folders are made; None: not written): how many could be, and what went wrong for others.

    Rule tables are small by definition (rules.MOST_RULES).
    """
    from gridloom.operators.rules import MOST_RULES

    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    done, errors = 0, []
    for tier, path in enumerate(paths):
        if path is None:
            continue
        try:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_text(rules_text([r for r in rows if r["tier"] == tier]))
            done += 1
        except OSError as error:
            errors.append(str(error))
    return done, errors


RECENTS = "path string, folder boolean, opened long, pinned boolean"


def load_recents(spark: SparkSession, path: str) -> DataFrame:
    """The list of documents opened before, pinned and newest first; empty on any failure."""
    try:
        rows = [(e["path"], bool(e.get("folder")), int(e["opened"]), bool(e.get("pinned"))) for e in tomllib.loads(Path(path).read_text()).get("recent", [])]
    except (OSError, tomllib.TOMLDecodeError, KeyError, TypeError, ValueError):
        rows = []
    return spark.createDataFrame(rows, RECENTS).orderBy(F.desc("pinned"), F.desc("opened"), "path")


def save_recents(recents: DataFrame, path: str, cap: int = 40) -> None:
    rows = recents.orderBy(F.desc("pinned"), F.desc("opened"), "path").limit(cap).collect()
    text = "".join("[[recent]]\n" + "".join(f"{c} = {_literal(r[c])}\n" for c in ("path", "folder", "opened", "pinned")) for r in rows)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """entries: place, name, source, and layer (one row each; NULL: the whole file), subsets before whole files."""
    book = tomllib.loads(text)
    rows, place = [], 0
    for section in ("subset", "whole"):
        for entry in book.get(section, []):
            for layer in entry.get("layers") or [None]:
                rows.append((place, entry["name"], entry["source"], layer))
            place += 1
    return spark.createDataFrame(rows, "place int, name string, source string, layer string")
