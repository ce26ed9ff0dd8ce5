"""Fixed values that must equal the planning application's behaviour.

Fixed values (kept together, in natural order):
  * average monthly hours used to turn hours into person-months: 140
  * posts per page: 25
  * API page size: 10 by default, 100 at most
  * audit-log page size (client side list): 50
  * audit rows exported per year: 120
  * audit retention: 365 days
  * cost concepts accepted by the cost form: Subcontracting, Material, Travel, Other
  * years accepted by the forms: 2020 to 2030
  * months accepted by the forms: 1 to 12
  * dedication accepted by the form: 0 to 100 percent
  * longest language tag kept: 5 characters
  * load bands of a person-month cell: (1, 3] over, (0.5, 0.8] light, <= 0.5 low, otherwise none
"""

AVG_MONTHLY_HOURS = 140.0
POSTS_PER_PAGE = 25
API_PER_PAGE_DEFAULT = 10
API_PER_PAGE_MAX = 100
CHANGELOG_PAGE_SIZE = 50
CHANGELOG_ROWS_PER_YEAR = 120
RETENTION_DAYS = 365
COST_CONCEPTS = ("Subcontracting", "Material", "Travel", "Other")
YEAR_RANGE = (2020, 2030)
MONTH_RANGE = (1, 12)
DEDICATION_PERCENT_RANGE = (0, 100)
MAX_LANGUAGE_TAG_LEN = 5

# BM25 parameters of the published formula (Robertson / Sparck Jones), as used
# by common search servers by default.
BM25_K1 = 1.2
BM25_B = 0.75

# Width, in sequence numbers, of the ranges into which the ordered upsert
# splits the rows of one key (see operators/upsert.py): a window partition
# holds at most this many rows, so a hot key never lands in a single task.
UPSERT_SEQ_BUCKET = 1 << 20
