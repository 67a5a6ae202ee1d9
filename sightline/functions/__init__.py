"""Column functions: plates, calendar, geometry and numbers."""
