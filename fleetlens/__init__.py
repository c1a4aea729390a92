"""fleetlens: machine-telemetry analytics as plain Spark DataFrame functions.

Every operator takes DataFrames plus parameters and returns a DataFrame, so the
same function serves batch jobs and Structured Streaming queries.  Operators do
not read the clock: whatever depends on "now" takes an ``as_of`` argument.
"""

__version__ = "0.1.0"
