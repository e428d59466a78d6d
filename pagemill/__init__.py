"""pagemill: tables of raw web pages and documents turned into clean, ranked, verifiable content on Spark."""
