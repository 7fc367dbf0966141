"""Where sheets come from: workbook files, and tables bound as sheets."""
