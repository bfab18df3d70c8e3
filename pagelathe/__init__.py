"""pagelathe: page-corpus, log, conversation and file analytics on Spark."""
