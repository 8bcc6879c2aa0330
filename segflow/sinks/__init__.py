"""Writers for subtitles, tables and caches."""
