"""askmill.plans"""
