"""Every name that a function of the package reads is there."""

import builtins
import dis
import importlib
import pkgutil
from types import CodeType

import pytest

import barwright

MODULES = sorted(m.name for m in pkgutil.walk_packages(barwright.__path__, "barwright.") if not m.ispkg)


def globals_read(code: CodeType) -> set[str]:
    found = {x.argval for x in dis.get_instructions(code) if x.opname == "LOAD_GLOBAL"}
    return found.union(*(globals_read(c) for c in code.co_consts if isinstance(c, CodeType)))


@pytest.mark.parametrize("name", MODULES)
def test_names_are_defined(name):
    module = importlib.import_module(name)
    with open(module.__file__) as f:
        code = compile(f.read(), module.__file__, "exec")
    assert not {x for x in globals_read(code) if not hasattr(module, x) and not hasattr(builtins, x)}
