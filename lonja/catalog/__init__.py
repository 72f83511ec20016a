"""All registered queries."""

from lonja.catalog import analyses, feeds, general, home, maintenance, monitor, questions, review, trade
from lonja.catalog.registry import Catalog

CATALOG = Catalog()
for module in (general, trade, home, review, questions, analyses, monitor, maintenance, feeds):
    module.register(CATALOG)
