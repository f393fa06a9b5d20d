"""A Spark library for extracted web pages, traces and crawls."""
