from offerscore.sources.offers import read_offers, write_results  # noqa: F401
from offerscore.sources.view import offers_view, load_tables  # noqa: F401
