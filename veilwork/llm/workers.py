"""Objects that Python workers keep."""

from __future__ import annotations

import sys
import types


def kept(key, make):
    """An object that a worker process builds once and keeps over tasks."""
    store = sys.modules.setdefault("_veilwork_kept", types.ModuleType("_veilwork_kept"))
    if key not in store.__dict__:
        store.__dict__[key] = make()
    return store.__dict__[key]
