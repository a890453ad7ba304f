"""Column functions: everything here returns a Column and stays in the JVM
unless its docstring says it is an Arrow kernel."""
