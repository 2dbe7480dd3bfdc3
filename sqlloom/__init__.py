"""sqlloom: build, annotate and score text-to-SQL corpora on Spark."""
