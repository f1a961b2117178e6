"""cartledger: retail sales analytics as Spark jobs.

Raw order lines go in; a checked, deduplicated star schema, monthly marts and
a catalogue of reports come out.  Everything between a source and a sink is a
function from DataFrames to DataFrames.
"""

from cartledger.params import Params
from cartledger.warehouse import Warehouse

__all__ = ["Params", "Warehouse"]
