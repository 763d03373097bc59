"""plans of the engine."""

from . import registry  # loads the modules of queries in their order, whichever of them a Python worker asks for first
