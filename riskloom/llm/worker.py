"""What a Python worker keeps between the tasks it runs."""

from __future__ import annotations

import sys
import types


def kept(name: str, make):
    """The worker's own object of that name, made when it is first asked for.

    Functions travel to the workers by value, so what they close over is new in every
    task. This is for caches only: a new worker starts without, and results are the same.
    """
    home = sys.modules.setdefault("_riskloom_worker", types.ModuleType("_riskloom_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
