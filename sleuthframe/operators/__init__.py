"""sleuthframe.operators"""
