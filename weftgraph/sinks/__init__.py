"""Reports as files of lines, and rows for interactive readers."""
