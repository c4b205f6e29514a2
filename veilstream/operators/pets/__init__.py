"""Privacy-enhancing transformations (PETs) and their registry.

Three kinds of PET can be registered:

``column``  ``build(section, params) -> Column``: depends on the row only.
``window``  ``build(section, params) -> WindowPet``: depends on the last ``size`` rows.
``step``    ``build(section, params) -> StepPet``: each output depends on the output before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec

from veilstream.functions.petspec import PetSpec

SECTION_VALUE = {"speed": "scalar", "location": "location", "image": "image"}


@dataclass(frozen=True)
class WindowPet:
    """A PET over the last ``size`` rows.

    ``compute(rows, ordered, whole, prefix) -> (rows, value, ready)`` adds window columns named with
    the prefix and gives the processed value and the readiness as Columns over them; these are
    evaluated only for rows on which the PET is in force. ``columns`` are the inputs it reads.

    ``of_recent(recent) -> (value, ready)`` is the same over an array of the last rows (structs of
    ``generate_ms, scalar, x, y``, the current one last), which is what streams have.
    """

    size: int
    columns: tuple[str, ...]
    compute: Callable[[DataFrame, WindowSpec, WindowSpec, str], tuple[DataFrame, Column, Column]]
    of_recent: Callable[[Column], tuple[Column, Column]] | None = None


@dataclass(frozen=True)
class StepPet:
    """``make()`` returns ``(initial_state, step)``; ``step(state, value, ms, seed) -> (state, out)``.

    ``make`` must be picklable. ``state`` is a ``(value, ms)`` pair of float and int, either may be
    None at the start.
    """

    make: Callable[[], tuple]
    seed: object = 0


@dataclass(frozen=True)
class PetKind:
    kind: str
    build: Callable
    sections: tuple[str, ...]


REGISTRY: dict[str, PetKind] = {}


def register_pet(name: str, kind: str, build: Callable,
                 sections: tuple[str, ...] = ("speed",)) -> None:
    """Add a PET under a name that policies can use."""
    if kind not in ("column", "window", "step"):
        raise ValueError(f"unknown PET kind {kind!r}; known: column, window, step")
    REGISTRY[name] = PetKind(kind, build, sections)


def build_pet(spec: PetSpec, section: str):
    """``(kind, built PET)`` for a description. Unknown PETs and PETs that cannot handle the section
    are errors: nothing falls back to publishing raw data."""
    found = REGISTRY.get(spec.name)
    if found is None:
        raise ValueError(f"unknown PET {spec.name!r}; known: {', '.join(sorted(REGISTRY))}")
    if section not in found.sections:
        raise ValueError(f"PET {spec.name!r} cannot transform section {section!r}")
    return found.kind, found.build(section, spec.params)


def _register_built_in() -> None:
    from veilstream.operators.pets import geo, image, speed, window

    register_pet("none", "column", window.identity, ("speed", "location", "image"))
    register_pet("clamp", "column", window.clamped, ("speed",))
    register_pet("average", "window", window.sliding_mean, ("speed",))
    register_pet("median", "window", window.sliding_median, ("speed",))
    register_pet("geo", "window", geo.adaptive_geo, ("location",))
    register_pet("speed_noise", "step", speed.noisy_speed, ("speed",))
    register_pet("speed_limit", "step", speed.limited_speed, ("speed",))
    register_pet("image_redaction", "column", image.frame_redaction, ("image",))
    register_pet("class_redaction", "column", image.class_redaction, ("image",))


def section_value(section: str) -> Column:
    from pyspark.sql import functions as F
    return F.col(SECTION_VALUE[section])


_register_built_in()
