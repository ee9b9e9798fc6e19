from offerscore.streaming.files import rank_arriving_files  # noqa: F401
