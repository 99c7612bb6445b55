"""Library-wide execution choices."""

from __future__ import annotations

import os

# Ordered-window chunking (operators/windows.py): hex digits of the md5 prefix (16**d
# chunks) and the number of value-range chunks. More chunks = fewer rows per window
# task for a hot key; the (key, chunk) offset table grows accordingly (still small).
MD5_CHUNK_DIGITS = int(os.environ.get("COHORT_MD5_CHUNK_DIGITS", "3"))
RANGE_CHUNKS = int(os.environ.get("COHORT_RANGE_CHUNKS", "256"))
