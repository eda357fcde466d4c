"""Models of slices: what they take, where they are loaded, what becomes of their failures."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: (rgb[N, h, w, 3] of 8 bits, prompt points (x, y) of each slice) -> water[N, h, w].
Model = Callable[[np.ndarray, list[np.ndarray]], np.ndarray]
#: The models that this Python worker has loaded, by the token of their factory.
_LOADED: dict[str, Model] = {}


@dataclass(frozen=True)
class Factory:
    """A model that is loaded where it is used: make() runs once in each Python worker that needs it, whatever the tasks and slices, and the model itself never travels with a plan."""

    make: Callable[[], Model]
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


def loaded(model: Model | Factory | None) -> Model | None:
    """The model itself; that of a factory is kept for as long as the worker lives."""
    if not isinstance(model, Factory):
        return model
    if model.token not in _LOADED:
        _LOADED[model.token] = model.make()
    return _LOADED[model.token]


def failure(e: Exception) -> str:
    """The text of an error row."""
    return f"{type(e).__name__}: {e}"[:2000]
