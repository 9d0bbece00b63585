"""All queries of the core, by name, with their SQL."""

from skygrid.plans import climate, quality

QUERIES = {**climate.QUERIES, **quality.QUERIES}
SQL = {**climate.SQL, **quality.SQL}
