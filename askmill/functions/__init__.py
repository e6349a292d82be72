"""askmill.functions"""
