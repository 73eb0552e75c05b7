"""Column functions of the library in one place: each takes and gives columns."""

from gridloom.operators.layout import cyclic_distance, fitted_interval, fitted_width, gcd, preferred_phase, quantum
from gridloom.operators.quantise import canonical
from gridloom.operators.rings import axis_name, without_axis_points, without_straight_points
from gridloom.operators.solutions import compact_entry
from gridloom.sources.payloads import json_safe, short_number, solver_name

__all__ = [
    "axis_name", "canonical", "compact_entry", "cyclic_distance", "fitted_interval", "fitted_width", "gcd", "json_safe", "preferred_phase", "quantum", "short_number", "solver_name", "without_axis_points", "without_straight_points",
]
