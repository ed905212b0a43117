"""Where documents come from: PDF bytes, their syntax, filters and encryption, and a writer for test corpora."""
