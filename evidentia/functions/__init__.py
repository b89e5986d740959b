"""Column functions: no function here touches a DataFrame."""
