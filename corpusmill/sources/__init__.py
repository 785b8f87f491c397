"""Sources and sinks: folders of text files, and datasets and results as JSON."""
