"""The configuration: a TOML file with a strict schema, the environment over it, errors by section and field."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from .limits import Limits
from .operators.policy import IMPORTANCE

PREFIX = "POSTLAKE"


class ConfigError(ValueError):
    """All that is wrong with a configuration, a line each."""


@dataclass(frozen=True)
class Source:
    folder: str = ""
    archive: str = ""
    poll_seconds: int = 120


@dataclass(frozen=True)
class Delivery:
    active: str = "console"
    min_importance: str = "normal"
    digest_hour: int = 18
    footnote: bool = False


@dataclass(frozen=True)
class Model:
    provider: str = "none"
    model: str = ""
    base_url: str = ""
    max_tokens: int = 0


@dataclass(frozen=True)
class Config:
    source: Source = field(default_factory=Source)
    delivery: Delivery = field(default_factory=Delivery)
    model: Model = field(default_factory=Model)
    critic: Model = field(default_factory=lambda: Model(provider=""))
    limits: Limits = field(default_factory=Limits)
    state_dir: str = ""

    def critic_model(self) -> Model:
        """The critic's settings; what is empty there is the model's."""
        own = self.critic
        return Model(own.provider or self.model.provider, own.model or self.model.model, own.base_url or self.model.base_url, own.max_tokens or self.model.max_tokens)


_SECTIONS = {"source": Source, "delivery": Delivery, "model": Model, "critic": Model, "limits": Limits}


def _with_env(data: Mapping[str, Any], env: Mapping[str, str]) -> dict[str, Any]:
    """Variables like POSTLAKE_DELIVERY_ACTIVE over the file; a section that is no table is left for the check."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in data.items()}
    for section, kind in _SECTIONS.items():
        for f in fields(kind):
            value = env.get(f"{PREFIX}_{section}_{f.name}".upper())
            if value is not None and isinstance(out.setdefault(section, {}), dict):
                out[section][f.name] = int(value) if f.type == "int" and value.lstrip("-").isdigit() else value
    return out


def load_dict(data: Mapping[str, Any], env: Mapping[str, str] | None = None) -> Config:
    data = _with_env(data, os.environ if env is None else env)
    wrong: list[str] = []
    made: dict[str, Any] = {}
    for name, value in data.items():
        if name == "state_dir" and isinstance(value, str):
            made[name] = value
            continue
        kind = _SECTIONS.get(name)
        if kind is None or not isinstance(value, dict):
            wrong.append(f"[{name}] is {'no section' if kind is None else 'no table'}")
            continue
        base = Model(provider="") if name == "critic" else kind()
        known = {f.name: getattr(base, f.name) for f in fields(kind)}
        good = {}
        for key, x in value.items():
            if key not in known:
                wrong.append(f"[{name}] {key}: unknown")
            elif not isinstance(tuple(x) if isinstance(x, list) else x, type(known[key])) or (isinstance(x, bool) and not isinstance(known[key], bool)):
                wrong.append(f"[{name}] {key}: {type(known[key]).__name__} expected")
            elif isinstance(x, int) and x < 0:
                wrong.append(f"[{name}] {key}: must not be negative")
            else:
                good[key] = tuple(x) if isinstance(x, list) else x
        made[name] = replace(base, **good)
    config = Config(**made)
    if config.delivery.min_importance not in IMPORTANCE:
        wrong.append(f"[delivery] min_importance: one of {', '.join(IMPORTANCE)} expected")
    if config.model.provider != "none" and not config.model.model:
        wrong.append("[model] model: needed unless the provider is none")
    if not 0 <= config.delivery.digest_hour <= 23:
        wrong.append("[delivery] digest_hour: 0 to 23 expected")
    if wrong:
        raise ConfigError("\n".join(wrong))
    return config


def load(path: str | Path, env: Mapping[str, str] | None = None) -> Config:
    with open(path, "rb") as f:
        return load_dict(tomllib.load(f), env)


def state_dir(config: Config, path: str | Path | None = None) -> str:
    """Where state lies: as configured, from the file's folder if relative; else beside the file."""
    base = Path(path).parent if path else Path()
    return str(base / Path(config.state_dir).expanduser()) if config.state_dir else str(base / "state")


def toml_value(value: Any) -> str:
    """A value as TOML. Texts are escaped as in JSON, which TOML reads alike but for the delete character."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007F")
    if isinstance(value, list | tuple):
        return f"[{', '.join(map(toml_value, value))}]"
    raise ConfigError(f"a {type(value).__name__} can't be written")


def render(data: Mapping[str, Any]) -> str:
    """The configuration as TOML: what has no section, then sections in the schema's order, and in them known fields in theirs; others keep their order."""

    def ordered(names: list[str], known: list[str]) -> list[str]:
        return sorted(names, key=lambda n: known.index(n) if n in known else len(known))

    out = [f"{k} = {toml_value(v)}" for k, v in data.items() if not isinstance(v, dict)]
    for name in ordered([k for k, v in data.items() if isinstance(v, dict)], list(_SECTIONS)):
        known = [f.name for f in fields(_SECTIONS[name])] if name in _SECTIONS else []
        out += ["", f"[{name}]", *(f"{k} = {toml_value(data[name][k])}" for k in ordered(list(data[name]), known))]
    return "\n".join(out).lstrip("\n") + "\n"


def write_private(path: str | Path, text: str) -> None:
    """A file that only its owner reads, whole or not at all; a link in its place is replaced, not followed."""
    path = Path(path)
    handle, beside = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        Path(beside).unlink(missing_ok=True)
        raise


def write_folder(folder: str | Path, files: Mapping[str, str]) -> None:
    """Files into a folder that is new or empty; names are plain ones."""
    folder = Path(folder)
    if bad := sorted(n for n in files if n != Path(n).name or n in ("", ".", "..")):
        raise ConfigError(f"no plain names: {', '.join(bad)}")
    if folder.is_symlink() or (folder.exists() and (not folder.is_dir() or any(folder.iterdir()))):
        raise ConfigError(f"{folder} is not an empty folder")
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        write_private(folder / name, text)


def save(path: str | Path, data: Mapping[str, Any]) -> Config:
    """Write a configuration that reads back as it is; one that wouldn't is refused, and the old file stays."""
    config, text = load_dict(data, {}), render(data)
    if load_dict(tomllib.loads(text), {}) != config:
        raise ConfigError("the configuration does not read back")
    write_private(path, text)
    return config
