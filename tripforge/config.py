"""Paths, environment values, reports and manifests, on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
from pathlib import Path

import pyspark

# The forms of names that requests and feedback may have, and the actions.
ALIAS = re.compile(r"demo_rider_(full|light|cold)")
REQUEST = re.compile(r"rec_[a-f0-9]{16}")
ACTIONS = ("impression", "restaurant_clicked", "explanation_opened", "ride_clicked")


#: A setting of an environment file: a name, an equals sign, a value in quotes or not.
SETTING = re.compile(r"""^[ \t]*(\w+)[ \t]*=[ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|([^\n]*?))[ \t]*$""", re.M)


def env_file(path: str | Path) -> dict[str, str]:
    """The settings of a file, none if there is no such file."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        return {}
    return {m[1]: m[2] or m[3] or m[4] or "" for m in SETTING.finditer(text)}


def choose_input(root: str | Path, given: str | None = None, defaults: tuple[str, ...] = ("data/raw/trips.csv", "data/trips.csv")) -> Path:
    """The argument, RAW_DATA_PATH, the same in .env, then the defaults: the first that exists."""
    names = [given, os.environ.get("RAW_DATA_PATH"), env_file(Path(root) / ".env").get("RAW_DATA_PATH"), *defaults]
    for name in filter(None, names):
        if (path := Path(root) / name).is_file():
            return path
    raise FileNotFoundError("no input file was found")


#: Where outputs go, by the setting that may say otherwise.
OUTPUTS = {"PROCESSED_DATA_DIR": "data/processed", "REPORT_DIR": "data/reports"}


def choose_output(root: str | Path, setting: str, given: str | None = None) -> Path:
    """The argument, the setting of the environment or of .env, then its default; below root
    unless it is absolute."""
    named = given or os.environ.get(setting) or env_file(Path(root) / ".env").get(setting) or OUTPUTS.get(setting, "data/reports")
    return (Path(root) / named).resolve()


def read_json(path: str | Path):
    return json.loads(Path(path).read_text(encoding="utf-8"))


def file_digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_json(path: str | Path, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def manifest(inputs: list, settings: dict, content: dict, artifacts: list = ()) -> dict:
    """What an artifact was made of: digests of inputs and of files that belong to it, its
    settings, and the versions that made it."""
    made = {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__}
    told = {"inputs": {str(p): file_digest(p) for p in inputs}, "settings": settings, "content": content, "versions": made}
    return told | ({"artifacts": {str(p): file_digest(p) for p in artifacts}} if artifacts else {})


def matches(path: str | Path, wanted: dict) -> bool:
    """Whether an artifact with this manifest exists; one with other inputs raises."""
    if not Path(path).is_file():
        return False
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if found.get("inputs") != wanted.get("inputs"):
        raise ValueError("an artifact of other inputs is there already")
    plain = lambda m: {k: v for k, v in m.items() if k != "versions"}  # noqa: E731  another version may make the same
    return plain(found) == plain(json.loads(json.dumps(wanted, default=str)))


def validate_location(lat: float, lng: float, name: str = "x") -> None:
    if not (24.8 <= lat <= 25.4 and 121.3 <= lng <= 122.1 and 1 <= len(name) <= 80):
        raise ValueError("the location is out of bounds")


def validate_feedback(request_id: str, place_key: str, action: str) -> None:
    if not REQUEST.fullmatch(request_id) or not 1 <= len(place_key) <= 80 or action not in ACTIONS:
        raise ValueError("malformed feedback")
