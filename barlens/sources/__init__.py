"""Sources: driver tables, the derived bar tables, the raw feed and dimensions."""

from barlens.sources.tables import read_table
from barlens.sources.bars import (bars, bars_dirty, bars_wide, dim_date, dim_market,
                                  feed, feed_dirty, feed_wide, history, price_factors)
from barlens.sources.files import (read_bars, read_feed_files, write_bars,
                                   write_feed_files, write_once)

__all__ = ["read_table", "bars", "bars_dirty", "bars_wide", "dim_date", "dim_market",
           "feed", "feed_dirty", "feed_wide", "history", "price_factors", "read_bars", "read_feed_files",
           "write_bars", "write_feed_files", "write_once"]
