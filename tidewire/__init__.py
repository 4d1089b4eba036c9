"""tidewire: news-corpus analytics as Spark DataFrame-to-DataFrame operators."""
