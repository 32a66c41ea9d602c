"""Parameters of the registered fixture queries.

Fixed values: the "now" of each fixture source (its last date, checked at
sf0.001 / 0.01 / 0.1) — reports that read the clock in the source system take
these as ``as_of`` so results are reproducible.
"""

ORDERS_AS_OF = "2001-08-01 00:00:00"
LINEITEM_AS_OF = "2001-11-04 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

STUDENT_QUERY = "machinery"
PAGE_CHANNEL = "whatsapp"
PAGE_LIMIT = 50
PAGE_OFFSET = 10
SEARCH_LIMIT = 100
TRANSACTION_LIMIT = 200
RECENT_ROWS_LIMIT = 100

# X49 on the fixture: 3 requests per client per 12 hours, so rejections occur.
RATE_LIMIT = 3
RATE_WINDOW_SECONDS = 12 * 3600
# W50: the seeded thresholds (40 / 300 / 30 / 35 dollars) as they are.
COST_RULE_SCALE = 1.0
# Vector search: a second threshold that does cut top-10 lists; memory k; IVF shape.
STRICT_MIN_SIMILARITY = 0.3
MEMORY_K = 10
IVF_PROBES = 2
# The index whose lists follow the rows: rows of a list, lists a split makes at most, lists a query ends in.
LIST_ROWS = 64
LIST_FANOUT = 64
LIST_BEAM = 40
# Facet combinations are counted for the materials with the most techniques (a top-n report).
FACET_MATERIALS = 20
# Trends by week from day sketches: six standard deviations of a sketch with 2 ** 12 registers.
SKETCH_ERROR = 0.1
FIRST_DAY = "1970-01-01 00:00:00"
