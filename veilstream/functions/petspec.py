"""PET descriptions: JSON columns on the cluster, parsed objects on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.schemas import PET


def parse_pet(pet: Column) -> Column:
    """A JSON column as a struct with the fixed PET schema."""
    return F.from_json(pet, PET, {"primitivesAsString": "false"})


def is_stateful(parsed: Column) -> Column:
    """True if any state window is a TIME window or keeps more than one record."""
    return F.exists(
        parsed["stateWindow"],
        lambda w: (F.upper(w["type"]) == "TIME") | (w["size"] > 1),
    )


def pet_label(parsed: Column) -> Column:
    """Name followed by all parameter values: tells apart one PET with different parameters."""
    values = F.transform(parsed["parameters"], lambda p: p["value"])
    return F.concat(parsed["name"], F.array_join(values, ""))


def affected_sections(parsed: Column, own_section: Column) -> Column:
    """The PET's output sections, or the record's own section when it names none."""
    outputs = parsed["outputDataSection"]
    return F.when(F.size(outputs) > 0, outputs).otherwise(F.array(own_section))


@dataclass(frozen=True)
class StateWindow:
    section: str
    kind: str
    size: int

    @property
    def stateful(self) -> bool:
        return self.kind == "TIME" or self.size > 1


@dataclass(frozen=True)
class PetSpec:
    """A PET description known on the driver (policies are small)."""

    name: str
    params: tuple
    label: str
    windows: tuple[StateWindow, ...] = ()
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()

    @property
    def stateful(self) -> bool:
        return any(w.stateful for w in self.windows)

    @staticmethod
    def from_json(text: str) -> PetSpec:
        raw = json.loads(text, parse_int=str, parse_float=str)
        missing = [key for key in ("name", "stateWindow", "parameters",
                                   "inputDataSection", "outputDataSection") if key not in raw]
        if missing:
            raise ValueError(f"PET description lacks {', '.join(missing)}")
        windows = []
        for w in raw["stateWindow"]:
            kind = w["type"].upper()
            if kind not in ("TIME", "PIECE"):
                raise ValueError(f"{w['type']!r} is not a window type; known: TIME, PIECE")
            windows.append(StateWindow(w["dataSection"], kind, int(w["size"])))
        params = raw["parameters"]
        return PetSpec(
            name=raw["name"],
            params=tuple(_typed(p["type"], p["value"]) for p in params),
            label=raw["name"] + "".join(_text(p["value"]) for p in params),
            windows=tuple(windows),
            inputs=tuple(raw["inputDataSection"]),
            outputs=tuple(raw["outputDataSection"]),
        )


def duration_ms(text: str) -> int:
    """Milliseconds of an ISO duration such as ``PT1M30S``, or of a plain number of seconds."""
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return round(float(text) * 1000)
    found = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not found or not any(found.groups()):
        raise ValueError(f"not a duration: {text!r}")
    days, hours, minutes, seconds = (float(g or 0) for g in found.groups())
    return round((((days * 24 + hours) * 60 + minutes) * 60 + seconds) * 1000)


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _boolean(value) -> bool:
    text = _text(value).lower()
    if text not in ("true", "false"):
        raise ValueError(f"not a boolean: {value!r}")
    return text == "true"


def _typed(type_name: str, value):
    kind = type_name.rsplit(".", 1)[-1]
    convert = {"Integer": int, "Long": int, "Double": float, "String": str, "Boolean": _boolean,
               "Duration": duration_ms}.get(kind)
    if convert is None:
        raise ValueError(f"unsupported parameter type {type_name!r}")
    return convert(value)


def pet_json(name: str, params=(), windows=(), inputs=(), outputs=()) -> str:
    """Write a description: ``params`` are (type, value), ``windows`` (section, type, size)."""
    return json.dumps({
        "name": name,
        "stateWindow": [{"dataSection": s, "type": t, "size": n} for s, t, n in windows],
        "parameters": [{"type": t, "value": v} for t, v in params],
        "inputDataSection": list(inputs),
        "outputDataSection": list(outputs),
    })
