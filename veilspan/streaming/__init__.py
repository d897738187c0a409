"""The batch operators over a file stream."""
