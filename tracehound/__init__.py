"""tracehound: lineage incident analysis as Spark DataFrame jobs.

Tables in, tables out: incidents, lineage edges, entities and tags are
DataFrames; walks, enrichment, ranking, containment and reports are
DataFrame plans keyed by ``incident_id``.
"""

__version__ = "0.1.0"
