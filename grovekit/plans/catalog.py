"""All registered queries outside the ``llm`` subpackage."""

from __future__ import annotations

import importlib

from grovekit.plans.registry import Registry

#: Modules with a ``register(registry)`` function, in order.
MODULES = [f"grovekit.plans.{m}" for m in ("documents", "projections", "joins", "aggregates", "windows", "groups", "io", "models", "surfaces")]


def build() -> Registry:
    reg = Registry()
    for name in MODULES:
        importlib.import_module(name).register(reg)
    return reg
