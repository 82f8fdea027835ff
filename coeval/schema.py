"""Table layouts. Readers always pass one of these; nothing is inferred."""

from __future__ import annotations

NODES = ("draw_id INT, node_id BIGINT, time DOUBLE")
EDGES = ("draw_id INT, `left` DOUBLE, `right` DOUBLE, parent BIGINT, child BIGINT")
DRAW_SITES = ("draw_id INT, site_id BIGINT, position DOUBLE")
MUTATIONS = ("draw_id INT, mutation_id BIGINT, site_id BIGINT, node_id BIGINT")
CHROMOSOMES = ("chrom STRING, offset BIGINT, length BIGINT")
SITES = ("row_id BIGINT, position BIGINT, present_draws BIGINT, missing_draws BIGINT, "
    "usable_draws BIGINT, usable_intervals BIGINT, skipped_roots BIGINT, "
    "valid BOOLEAN, eligible BOOLEAN"
)
INTERVALS = ("row_id BIGINT, draw_id INT, mutation_id BIGINT, below DOUBLE, above DOUBLE, "
    "usable_intervals BIGINT"
)
DRAW_STATUS = ("draw_id INT, row_id BIGINT, status INT")
PROFILES = ("row_id BIGINT, bins ARRAY<INT>, slopes ARRAY<DOUBLE>, "
    "intercepts ARRAY<DOUBLE>, completes ARRAY<DOUBLE>"
)

# Draw status codes (fixed values): absent, present without a usable
# interval, usable. Code 3 is reserved.
STATUS_ABSENT = 0
STATUS_UNUSABLE = 1
STATUS_USABLE = 2

# Quantised CDF scale (fixed value): unsigned 16-bit full range.
CDF_SCALE = 65535
