"""DataFrame operators over corpora and term tables."""
