"""Extensions beyond batch: notes from a stream of files."""
