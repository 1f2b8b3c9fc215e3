"""Lower-casing by simple (one to one) mappings, independent of position and locale."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capitals whose simple mapping differs from Java's full one or is newer than Java's tables.
FROM = "İΣ꟎꟒꟔" + "".join(chr(c) for c in range(0x16EA0, 0x16EB9))
TO = "iσ꟏ꟓꟕ" + "".join(chr(c + 27) for c in range(0x16EA0, 0x16EB9))


def simple_lower(text: Column) -> Column:
    return F.lower(F.translate(text, FROM, TO))
